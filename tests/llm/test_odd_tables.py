"""Every operator and stage over nulls, empty and very long texts, repeats, ties, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passagelake.llm import fingerprints, language, lm, media, mixing, packing, sharding, simhash, simhash_long, toxicity, url_filter
from passagelake.llm.queries import tokenizer_path

NAMES = ("odd", "none", "clashing")


@pytest.fixture(params=NAMES)
def docs(request):
    return request.getfixturevalue(request.param)


def test_sharding(docs):
    rows = sharding.interleaved_shards(docs.select("doc_id", "source"), 5).collect()
    assert len(rows) == docs.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert not rows or max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    if rows:
        of = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
        zero = {c for (k, fp), c in of.items() if fp == 0}
        assert zero == {3}  # null, empty and blank texts are one component
        assert {c for (k, _), c in of.items() if k in (1, 2)} == {1}
        assert all(c == k for (k, fp), c in of.items() if k == 7)


def test_media(docs):
    rows = media.media_digests(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 and r["codec"] == "raw"
    for key in (3, 4):
        assert all(r["n_bytes"] == 0 and r["payload_bytes"] == 192 for r in rows if r["doc_id"] == key)


def test_packing(docs):
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    total = sum(r["length"] for r in rows)
    assert total == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert sum(1 for r in rows if r["start"] == 0) == docs.count()
    lengths = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths.get(r["sequence_id"], 0)
        lengths[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths.values())


def test_fingerprints(docs):
    rows = fingerprints.edit_likeness(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.fingerprints(docs).count() == len(rows)


def test_language(docs):
    model = language.fit(docs)
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages
    assert language.language_spans(docs, model).count() == len(rows)
    assert {r["lang_pred"] for r in language.identify(docs, language.Model()).collect()} <= {"und"}


def test_lm(docs):
    rows = lm.fit_and_score(docs, F.lit(True)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_known"] == r["n_tokens"] >= 1 and r["score"] < 0 and r["base_score"] < 0
    unseen = lm.fit_and_score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in unseen)


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (7, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.score_toxicity(docs, toxicity.fit_lexicon(docs, some, F.lit(True))).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_mixing(docs):
    rows = mixing.mix_sources(docs, ("lang", "source"), ({"en": 0.5}, {}), 0.7, 2, mixing.word_count(F.col("text"))).collect()
    assert all(r["epoch"] in (0, 1) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_mixing_keeps_to_its_limits(spark, seed):
    """Rows of 0 tokens, repeated keys and rows, and null keys: max_epochs holds, and a leaf is within a row of its budget."""
    rows = [(1, " ".join(["w"] * 3), "a")] * 400 + [(2, " ".join(["w"] * n), "a") for n in range(60)] + [(k, "", "b") for k in range(20)] + [(100 + k, "x y z", "b") for k in range(40)] + [(None, f"v{k} w", "c") for k in range(50)] + [(7, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for share in (0.11, 0.9, 1.0, 5.0):
        tokens = mixing.word_count(F.col("text"))
        plan = {r["source"]: r["budget"] for r in mixing.plan_mixture(docs, ("source",), ({},), share, 2, tokens, seed=seed).collect()}
        out = mixing.mix_sources(docs.withColumn("epoch", F.lit("own")), ("source",), ({},), share, 2, tokens, seed=seed).withColumn("t", tokens).collect()
        assert all(r["epoch"] in (0, 1) for r in out) and not any(r["source"] == "d" for r in out)
        for source, budget in plan.items():
            assert abs(sum(r["t"] for r in out if r["source"] == source) - budget) <= 30


@pytest.mark.parametrize("urls", [[], [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.NET/en/x?q=1#f"), (5, "http://a.example.net:80/en"), (None, "https://x.org/fr/1"), (6, "http://net"), (7, "x://" + "a/" * 50_000)]])
def test_url_filter(spark, urls):
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({n: F.lit("x") for n in ("block", "canonical", "rest", "w0")})
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")]
    listed = pages.where("page_id = 7").select(url_filter.canonical_url(F.col("url")).alias("canonical"))
    rows = url_filter.judge_pages(pages, rules, listed).collect()
    assert len(rows) == len(urls)
    found = [(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in rows if r["page_id"] != 7]
    if urls:
        assert sorted(found, key=str) == sorted([(1, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "", None, "allow"), (5, "a.example.net", "example.net/en/", "allow"), (5, "a.example.net:80", None, "allow"), (None, "x.org", "org/fr/", "allow"), (6, "net", None, "allow")], key=str)
        assert [r["verdict"] for r in rows if r["page_id"] == 7] == ["block"]


OUTPUTS = (
    "shard", "slot", "fp", "component_id", "n_bytes", "payload_bytes", "media_bytes", "feature", "codec", "seconds", "media_codec", "media_kind", "media_seconds", "media_keyframes", "media_error",
    "start", "length", "sequence_id", "offset", "doc_tokens", "fingerprint", "near_next", "within_radius", "lang_pred", "lang_score", "spans", "held_out", "n_tokens", "n_known", "base_score", "score",
    "predicted", "host", "path", "rule", "verdict", "is_listed", "epoch", "key", "hash", "row", "id", "digest", "n", "group", "bucket", "tokens", "y", "x", "place", "tail", "token", "c",
)

OPERATORS = {
    "shards": lambda d: sharding.interleaved_shards(d, 3),
    "simhash": lambda d: simhash.near_duplicates(d),
    "media": lambda d: media.media_columns(d.withColumn("content", F.encode("text", "utf-8"))),
    "digests": lambda d: media.media_digests(d),
    "packing": lambda d: packing.pack_documents(d, tokenizer_path()),
    "likeness": lambda d: fingerprints.edit_likeness(d),
    "radius": lambda d: fingerprints.count_within_radius(d.withColumn("fingerprint", F.lpad(F.col("doc_id").cast("string"), 32, "0")), F.col("doc_id") > 5),
    "languages": lambda d: language.identify(d, language.fit(d)),
    "spans": lambda d: language.language_spans(d, language.fit(d)),
    "lm": lambda d: lm.fit_and_score(d, F.lit(True)),
    "urls": lambda d: url_filter.judge_pages(d.withColumn("url", F.concat(F.lit("http://a.net/"), "source")), [("block", "net", "/")], d.select(F.col("source").alias("canonical"))),
    "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Lexicon({" cat ": 1.0})),
    "mixing": lambda d: mixing.mix_sources(d, ("lang", "source"), ({}, {}), 0.7, 2, mixing.word_count(F.col("text"))),
    "near-dedup": lambda d: simhash_long.first_of_each(d),
}


@pytest.mark.parametrize("operator", OPERATORS)
def test_names_of_outputs_as_columns(operator, odd, tmp_path):
    """Results can be written where the table's further columns bear the names of outputs and helpers."""
    docs = odd.withColumns({n: F.lit("own") for n in OUTPUTS})
    out = OPERATORS[operator](docs)
    assert len(set(out.columns)) == len(out.columns)
    out.write.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("name", NAMES)
def test_stages(name, request, spark, tmp_path):
    docs = request.getfixturevalue(name)
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
    assert name == "none" or docs.count() > 0
