"""Main text of HTML pages: gradient-boosted trees over DOM nodes, and a decoding by which nothing below a dropped node is kept.

The trees are trained on pages whose roles are known: a sample of the table whose article element tells them, and pages laid out from the sample's own
words with menus, adverts, notices, forms, sidebars and comments in many markups, of which some bear no telling name.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .common import slices
from .dom import KIND, ROLES, Nodes, described

#: Pages that are sampled, those laid out, and the characters of a sampled page's run whose words are taken.
SAMPLED, LAID_OUT, POOL_CHARS = 200, 500, 400
#: Characters of HTML that are worked on at once; a longer page is worked on alone.
AT_ONCE = 4_000_000

BITS = {name: 1 << i for i, name in enumerate(ROLES)}
NOT_MAIN = sum(BITS[name] for name in ROLES if name not in ("content", "hidden"))


def decoded(nodes: Nodes, log_odds: np.ndarray) -> list[bool]:
    """The likeliest labels by which all below a dropped node is dropped and a kept one holds a kept one. A page's root is kept, and may be empty."""
    keep, drop = (-np.logaddexp(0, -log_odds)).tolist(), (-np.logaddexp(0, log_odds)).tolist()
    parent, n = nodes.parent, len(nodes.parent)
    kept = [False] * n
    lost, nearest = [math.inf] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        p = parent[i]
        if nodes.text[i] is None:
            keep[i] -= max(lost[i], 0)
        if p == i:
            continue
        gap = drop[i] - keep[i]
        if gap < lost[p]:
            lost[p], nearest[p] = gap, i
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    for i in range(n):
        p = parent[i]
        kept[i] = p == i or kept[p] and (keep[i] > drop[i] or nearest[p] == i and parent[p] != p)
    return kept


def extracted(pages: list[str], model: Trees) -> list[str]:
    nodes = Nodes()
    for page in pages:
        nodes.read(page)
    kept = decoded(nodes, model.log_odds(described(nodes)))
    ends = [*nodes.roots[1:], len(nodes.parent)]
    return [" ".join(nodes.text[i] for i in range(a, b) if kept[i] and nodes.text[i] is not None) for a, b in zip(nodes.roots, ends)]


class Layout:
    """One page of known roles, laid out at random. data-keep tells the role of all below."""

    def __init__(self, rng: random.Random, pool: list[list[str]]):
        self.rng, self.pool = rng, pool
        #: Elements of their own, telling names, or neither.
        self.style = rng.choices(("element", "name", "bare"), (0.45, 0.4, 0.15))[0]

    def words(self, low: int, high: int) -> str:
        source = self.rng.choice(self.pool)
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(source) - n))
        return " ".join(source[at : at + n] or source).replace("&", "&amp;").replace("<", "&lt;")

    def sentence(self, low: int = 4, high: int = 20) -> str:
        return self.words(low, high).rstrip(".,") + "."

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{text}</a>'

    def wrap(self, tag: str, names: list[str], inner: str, keep: int, plain: str = "div") -> str:
        rng, style = self.rng, self.style if self.rng.random() < 0.8 else self.rng.choice(("element", "name"))
        mark = f' data-keep="{keep}"'
        name = rng.choice(names) if names else ""
        if style == "element" and tag:
            named = f' class="{name}"' if name and rng.random() < 0.3 else ""
            return f"<{tag}{named}{mark}>{inner}</{tag}>"
        if style == "bare" or not name:
            obscure = f' class="{rng.choice("xyzqk")}{rng.randrange(99)}"' if rng.random() < 0.5 else ""
            return f"<{plain}{obscure}{mark}>{inner}</{plain}>"
        name = rng.choice((name, f"{name}-{rng.choice(('box', 'wrap', 'area', 'inner', 'x1'))}", f"{rng.choice(('page', 'the', 'c', 'js'))}-{name}"))
        return f'<{plain} {rng.choice(("class", "id"))}="{name}"{mark}>{inner}</{plain}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [self.link(self.words(1, 4)) for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.75 else " | ".join(items)

    def paragraph(self) -> str:
        rng = self.rng
        text = " ".join(self.sentence() for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9))))
        if rng.random() < 0.15:
            text += " " + self.link(self.words(1, 4)) + " " + self.sentence()
        return rng.choices((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{self.sentence(1, 8)}<br>", f"<div>{text}</div>", f"<p>{self.words(1, 3)}</p>"), (8, 1.5, 1.5, 1, 1))[0]

    def main(self) -> str:
        rng, parts = self.rng, []
        if rng.random() < 0.85:
            parts.append(f"<h1>{self.words(1, 12)}</h1>")
        for _ in range(rng.choice((0, 1, 1, 2, 4, 8, 15, 30))):
            parts.append(self.paragraph())
            extra = rng.random()
            if extra < 0.06:
                parts.append(f"<h2>{self.words(1, 8)}</h2>" + self.paragraph())
            elif extra < 0.09:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif extra < 0.11:
                parts.append(f"<blockquote><p>{self.sentence()}</p></blockquote>")
            elif extra < 0.125:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 6))) + "</table>")
            elif extra < 0.14:
                parts.append(f"<figure><figcaption>{self.sentence()}</figcaption></figure><pre>{self.words(3, 20)}</pre>")
            elif extra < 0.17:
                parts.append(rng.choice((self.advert, self.more, self.form))())
        return "".join(parts) if len(parts) > 1 else "".join(parts) + f"<p>{self.sentence()} {self.sentence()}</p>"

    def advert(self) -> str:
        return self.wrap("", ["ad", "ads", "advert", "sponsored", "promo", "banner-ad"], self.rng.choice((self.sentence(), f"<p>{self.sentence()}</p>", self.link(self.sentence()), self.sentence() + " " + self.sentence())), 0)

    def notice(self) -> str:
        return self.wrap(self.rng.choice(("", "aside", "dialog")), ["cookie-notice", "consent", "notice", "alert", "popup", "gdpr"], f"<p>{self.sentence()} {self.sentence()}</p>" + self.rng.choice(("", "<button>OK</button>", self.link(self.words(1, 2)))), 0)

    def navigation(self) -> str:
        return self.wrap("nav", ["nav", "menu", "navbar", "breadcrumbs", "main-menu"], self.links(), 0)

    def top(self) -> str:
        return self.wrap("header", ["header", "masthead", "site-header", "topbar"], self.rng.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.words(2, 6)}</p>")) + self.rng.choice(("", f"<p>{self.words(3, 9)}</p>", self.links(2, 6), self.navigation())), 0)

    def bottom(self) -> str:
        return self.wrap("footer", ["footer", "copyright", "site-footer", "colophon"], self.rng.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>{self.sentence()}</p>" + self.links(2, 5), f"<div>{self.links(2, 8)}</div><small>&copy; {self.words(1, 4)}</small>")), 0)

    def side(self) -> str:
        parts = [f"<h{self.rng.choice('234')}>{self.words(1, 3)}</h3>" + self.rng.choice((self.links(), f"<p>{self.sentence()}</p>", self.advert())) for _ in range(self.rng.randint(1, 3))]
        return self.wrap("aside", ["sidebar", "side", "widget", "rail"], "".join(parts), 0)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 2)}</label><input name=q>" for _ in range(self.rng.randint(1, 4)))
        return f'<form action="/x"{self.rng.choice(("", " class=newsletter", " id=search"))} data-keep="0">{self.rng.choice(("", f"<p>{self.sentence()}</p>"))}{fields}<button>{self.words(1, 1)}</button></form>'

    def comments(self) -> str:
        def one() -> str:
            text = " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3))))
            return f"<{{0}}><{{1}}>{self.words(1, 2)} {self.rng.randint(1, 28)}.{self.rng.randint(1, 12)}.</{{1}}><p>{text}</p>{self.rng.choice(('', self.link('Reply')))}</{{0}}>"

        outer, inner = self.rng.choice((("li", "div"), ("div", "span"), ("article", "header"), ("div", "b")))
        parts = "".join(one() for _ in range(self.rng.randint(1, 8))).format(outer, inner)
        return self.wrap("", ["comments", "comment-list", "discussion", "replies", "reader-comments"], f"<h3>{self.words(1, 3)}</h3>" + (f"<ol>{parts}</ol>" if outer == "li" else parts), 0, self.rng.choice(("div", "section")))

    def more(self) -> str:
        return self.wrap(self.rng.choice(("", "aside", "section")), ["related", "share", "social", "recommended", "more", "tags"], self.rng.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + self.links(2, 6), 0)

    def page(self) -> str:
        rng = self.rng
        some = lambda p, *makers: [m() for m in makers if rng.random() < p]
        before = some(0.6, self.top, self.navigation) + some(0.25, self.notice, self.advert, self.side, self.form)
        after = some(0.6, self.bottom) + some(0.3, self.comments, self.side, self.more) + some(0.15, self.form, self.advert, self.notice)
        rng.shuffle(before)
        tail = after[1:]
        rng.shuffle(tail)
        inside = some(0.15, self.comments, self.more)
        main = self.wrap(rng.choice(("article", "main", "article", "section")), ["content", "post", "entry-content", "article-body", "story", "main"], self.main(), 1, rng.choice(("div", "div", "section")))
        middle = main + "".join(inside)
        for _ in range(rng.choice((0, 0, 1, 2))):
            middle = f'<{(t := rng.choice(("div", "section", "main")))}{rng.choice(("", " class=wrap", " id=page"))}>{middle}</{t}>'
        return "<html><head><title>x</title></head><body>" + "".join(before) + middle + "".join(tail + after[:1]) + rng.choice(("</body></html>", ""))


def labels(nodes: Nodes, leaf: Callable[[int], bool]) -> np.ndarray:
    """1 for the leaves that leaf() keeps and all above them."""
    out = np.zeros(len(nodes.parent))
    for i in range(len(nodes.parent) - 1, -1, -1):
        if nodes.text[i] is not None:
            out[i] = leaf(i)
        if out[i]:
            out[nodes.parent[i]] = 1
    return out


def told_by_article(nodes: Nodes) -> np.ndarray:
    """Labels of pages that have an article or main element: what is in it and in nothing of another role."""
    inside = [False] * len(nodes.parent)
    for i, p in enumerate(nodes.parent):
        inside[i] = inside[p] or nodes.kind[i] == KIND["article"]
    return labels(nodes, lambda i: inside[i] and not (nodes.own[i] | nodes.inherited[i]) & NOT_MAIN)


def fit(pages: DataFrame, seed: int = 7) -> Trees:
    """Fit the trees on SAMPLED different pages of the table, those of least hash, and LAID_OUT pages made of their words."""
    told = pages.select(F.coalesce("html", F.lit("")).alias("html")).withColumn("hash", F.xxhash64("html"))
    last = told.select("hash").distinct().orderBy("hash").limit(SAMPLED).agg(F.max("hash")).first()[0]
    chosen = told.where(F.col("hash") <= F.lit(last)).groupBy("hash").agg(F.min("html").alias("html"))
    sample = [r.html for r in chosen.orderBy("hash").collect()]
    real, made = Nodes(), Nodes()
    for page in sample:
        if "<article" in page or "<main" in page:
            real.read(page)
    every = Nodes()
    for page in sample:
        every.read(page)
    pool = [t[:POOL_CHARS].split() for t in every.text if t and len(t) > 40] or ["words of no page at all, which stand in for those of a table without any text. They are few.".split()]
    rng = random.Random(seed)
    for _ in range(LAID_OUT):
        made.read(Layout(rng, pool).page())
    x, y = described(made), labels(made, lambda i: made.keep[i] == "1")
    if real.parent:
        x, y = np.concatenate([x, described(real)]), np.concatenate([y, told_by_article(real)])
    return fit_trees(x, y)


def extract_main(pages: DataFrame, model: Trees, html: str = "html") -> DataFrame:
    """pages with text (the main text; empty if there is none) and n_chars (its code points) in place of html.

    A null html counts as empty. Damaged markup is read as browsers do: missing end tags are implied, stray ones end a block. Rows are independent: repeated
    ones give repeated results. Columns of these names are replaced.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = [x or "" for x in batch.column(html).to_pylist()]
            for a, b in slices(list(map(len, htmls)), AT_ONCE):
                texts = extracted(htmls[a:b], model)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*others, "text", "n_chars"])

    told = pages.select(*others, html)
    schema = told.drop(html).schema.add("text", "string").add("n_chars", "long")
    return told.mapInArrow(run, schema)
