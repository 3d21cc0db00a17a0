import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import extraction
from passagelake.llm.boosting import fit_trees
from passagelake.llm.dom import Nodes


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return extraction.fit(pages)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_articles_of_the_table(pages, model):
    rows = pages.join(extraction.extract_main(pages, model), "page_id").select("html", "text", "n_chars").collect()
    assert rows and all(r.text == article(r.html) and r.n_chars == len(r.text) for r in rows)


BODY = "".join(f"<p>The committee met for the {n} time in spring, and after a long debate it agreed on new rules for the harbour. Ships must wait until noon.</p>" for n in ("first", "second", "third", "fourth"))
PLAIN = " ".join(re.sub("<p>", " ", BODY).replace("</p>", " ").split())


@pytest.mark.parametrize("around", [
    '<div class="cookie-notice"><p>We use cookies to make this site better. Do you agree?</p></div>{}',
    '{}<div id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>I do not think so. It is late.</p></div><div class="comment"><b>Bob</b><p>Well said, thank you.</p></div></div>',
    '<header><p>The Daily Page</p><nav><a href="/">Home</a> <a href="/x">News</a></nav></header>{}<aside class="sidebar"><h3>Read more</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another</a></li></ul></aside>',
    '{}<form action="/s"><p>Get our letter each week.</p><label>Mail</label><input><button>Send</button></form><footer>&copy; The page. All rights.</footer>',
    '<script>var a = "<p>no text</p>";</script><style>p{{}}</style><!-- <p>nor this</p> -->{}<noscript>Turn it on.</noscript>',
])
@pytest.mark.parametrize("main", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="page"><section class="entry-content">{}</section></div>'])
def test_pages_by_hand(model, around, main):
    page = "<html><head><title>t</title></head><body>" + around.format(main.format("<h1>New rules</h1>" + BODY)) + "</body></html>"
    assert extraction.extracted([page], model) == ["New rules " + PLAIN]


def test_layouts_not_seen(model):
    rng, pool = random.Random(5), [[f"word{i}," if i % 7 == 0 else f"word{i}" for i in range(200)]]
    right, each = 0, 0
    for _ in range(200):
        made = extraction.Layout(rng, pool)
        page, nodes = made.page(), Nodes()
        if made.style == "bare":
            continue
        nodes.read(page)
        gold = " ".join(t for t, k in zip(nodes.text, nodes.keep) if t is not None and k == "1")
        each += 1
        right += extraction.extracted([re.sub(r' data-keep="."', "", page)], model)[0] == gold
    assert right >= 0.85 * each


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(2)
    for _ in range(60):
        nodes, n = Nodes(), rng.randint(2, 9)
        parents = [0] + [rng.randrange(i) for i in range(1, n)]
        # nodes in page order: depth first
        order, children = [], {i: [j for j in range(1, n) if parents[j] == i] for i in range(n)}
        stack = [0]
        while stack:
            order.append(i := stack.pop())
            stack += children[i][::-1]
        place = {i: k for k, i in enumerate(order)}
        for i in order:
            nodes.add(place[parents[i]], 0, 0, 0, 0, None if children[i] or i == 0 else "x", 0, "")
        nodes.roots.append(0)
        odds = np.array([rng.gauss(0, 2) for _ in order])
        down = {place[i]: [place[j] for j in children[i]] for i in range(n)}

        def fits(keep):
            return all((not keep[i] or i == 0 or keep[nodes.parent[i]] or nodes.parent[i] == 0) and (not keep[i] or i == 0 or not down[i] or any(keep[j] for j in down[i])) for i in range(1, n))

        def worth(keep):
            return sum(-np.logaddexp(0, -odds[i]) if keep[i] else -np.logaddexp(0, odds[i]) for i in range(1, n))

        got = extraction.decoded(nodes, odds)
        ways = [[True] + [bool(m >> k & 1) for k in range(n - 1)] for m in range(1 << (n - 1))]
        assert fits(got)
        assert worth(got) == pytest.approx(max(worth(w) for w in ways if fits(w)))


def test_trees_split_a_corner():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.4)).astype(float)
    model = fit_trees(x[:3000], y[:3000], trees=20, depth=3)
    assert ((model.log_odds(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_reading_damaged_pages():
    def runs(page):
        nodes = Nodes()
        nodes.read(page)
        return [t for t in nodes.text if t is not None]

    assert runs("<p>a<p>b<ul><li>c<li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert runs("x &amp; y&nbsp;z &lt;b&gt; <b>in</b>line<br>break") == ["x & y z <b> inline break"]
    assert runs("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert runs('<div title="a>b">t</div></div></p>u < v <p class="unclosed>w') == ["t", "u < v", "w"]
    assert runs("<script>never ended <p>x") == [] and runs("<button>still <p>here") == ["still", "here"]
    assert runs("<div>" * 30_000 + "deep") == ["deep"]


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "no markup at all"), (4, "u", "<"), (5, "u", "<p>" + "long text here. " * 60_000), (6, "u", "<article><p>Same page. It is the same.</p></article>"), (6, "u", "<article><p>Same page. It is the same.</p></article>"), (7, "u", "a\0b\x1c c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "n_chars": F.lit(1), "extra": F.lit("kept")})
    out = extraction.extract_main(df, model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) and r.extra == "kept" for r in out)
    assert [r.text for r in out if r.page_id in (1, 2)] == ["", ""] and len({r.text for r in out if r.page_id == 6}) == 1
    none = df.where("false")
    assert extraction.extract_main(none, extraction.fit(none)).count() == 0
