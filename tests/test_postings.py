"""The kept inverted index against the search over texts."""

import random

import pytest
from pyspark.sql import functions as F

from passagelake.operators import postings, retrieval
from passagelake.sources.shared import kept

CHUNKS = "chunk_id string, owner_id string, document_id string, heading_path string, text string"
QUESTIONS = "question_id long, owner_id string, text string"


def rows(df):
    return sorted((r["question_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.choice((3, 8, 20, 90, 300))))
    chunks = [(f"c{i:05d}", "ab"[i % 4 == 0], rng.choice(("d1", "d2", "d3", "d4", None)), rng.choice(("", "W1 head", None)), text() if i % 40 else rng.choice((None, "", "..."))) for i in range(3000)]
    questions = [(i, "abc"[i % 3], " or ".join(rng.sample(words, rng.choice((1, 2, 5))))) for i in range(30)] + [(30, "a", None), (31, "a", "and or"), (32, None, "w1")]
    return spark.createDataFrame(questions, QUESTIONS), kept(spark.createDataFrame(chunks, CHUNKS), "corpus")


def test_index_finds_what_texts_give(spark, corpus, tmp_path):
    questions, chunks = corpus
    path = str(tmp_path / "index")
    postings.build_postings(chunks, path, buckets=8, block=64)
    for k, first in ((1, 1), (10, 2), (40, 1), (5000, 2)):
        assert rows(postings.lexical_topk_index(questions, path, k, first=first)) == rows(retrieval.lexical_topk(questions, chunks, k))


def test_blocks_are_skipped_and_bound_their_scores(spark, corpus, tmp_path):
    questions, chunks = corpus
    path = str(tmp_path / "index")
    postings.build_postings(chunks, path, buckets=8, block=64)
    search = postings.Search(questions, path)
    bounds = search.bounds()
    left, all_blocks = search.blocks(bounds, 10).count(), bounds.count()
    assert 0 < left < all_blocks / 2
    for b in bounds.orderBy(F.rand(1)).limit(5).collect():
        one = bounds.where((F.col("question_id") == b["question_id"]) & (F.col("block") == b["block"]))
        best = search.scores(one).agg(F.max("score")).first()[0]
        assert 0 < best <= b["bound"]
    sizes = spark.read.parquet(f"{path}/lists").agg(F.max(F.size("entries"))).first()[0]
    assert sizes <= 2 * 64
    plan = search.scores(bounds)._jdf.queryExecution().executedPlan().toString()
    assert "heading_path" not in plan and "dynamicpruning" in plan.lower()


def test_updates_deletions_and_merges(spark, corpus, tmp_path):
    questions, chunks = corpus
    path = str(tmp_path / "index")
    postings.build_postings(chunks, path, buckets=4, block=100)
    named = lambda *ids: spark.createDataFrame([(o, d) for o in "ab" for d in ids], "owner_id string, document_id string")
    same = lambda now: rows(postings.lexical_topk_index(questions, path, 20)) == rows(retrieval.lexical_topk(questions, now, 20))
    # d2 gets other texts and fewer chunks, rows without document go.
    other = chunks.where("document_id = 'd2' and chunk_id < 'c02000'").withColumn("text", F.concat(F.lit("w7 w7 w7 "), F.coalesce("text", F.lit(""))))
    postings.update_documents(other, named("d2", None), path)
    now = chunks.where("document_id in ('d1', 'd3', 'd4')").unionByName(other)
    assert same(now)
    # The same document once more, and another tenant's of that name stays.
    again = other.where("owner_id = 'a'").withColumn("text", F.lit("w3 w4"))
    postings.update_documents(again, named("d2").where("owner_id = 'a'"), path)
    now = now.where("not (document_id = 'd2' and owner_id = 'a')").unionByName(again)
    assert same(now)
    # A segment that was written but never published isn't seen.
    spark.read.parquet(f"{path}/lists/segment=0").write.partitionBy("bucket").parquet(f"{path}/lists/segment=3")
    assert same(now)
    postings.merge_segments(spark, path)
    assert [r["segment"] for r in postings.published(spark, path)] == [3] and same(now)


def test_odd_tables(spark, tmp_path):
    ask = spark.createDataFrame([(1, "a", "x y"), (2, "a", "")], QUESTIONS)
    postings.build_postings(spark.createDataFrame([], CHUNKS), str(tmp_path / "none"))
    assert postings.lexical_topk_index(ask, str(tmp_path / "none")).count() == 0
    few = spark.createDataFrame([("c", "a", None, "X", "y"), ("d", "a", None, None, "x y"), ("e", None, "q", "", "x"), ("long", "a", "q", "", "x " * 50_000)], CHUNKS).withColumn("best", F.lit(1))
    postings.build_postings(few, str(tmp_path / "few"))
    assert rows(postings.lexical_topk_index(ask, str(tmp_path / "few"))) == rows(retrieval.lexical_topk(ask, few))
    with pytest.raises(Exception, match="without id"):
        postings.build_postings(spark.createDataFrame([(None, "a", "d", "", "x")], CHUNKS), str(tmp_path / "bad"))


def test_chunks_are_dealt_whole_and_lists_once_more(spark, tmp_path, monkeypatch):
    """What is shuffled to build is texts and finished lists: no row for a place or a term of a chunk goes through a shuffle."""
    dealt = []
    monkeypatch.setattr(postings, "_counted", lambda analyzer, real=postings._counted: lambda rows: dealt.append(rows) or real(analyzer)(rows))
    chunks = spark.createDataFrame([(f"c{i}", "a", "d", "", "x y x z " * 50) for i in range(300)], CHUNKS)
    postings.build_postings(chunks, str(tmp_path / "index"), buckets=2, block=16)
    assert dealt[0].count() == 300 and "text" in dealt[0].columns and dealt[0].rdd.getNumPartitions() == 5
    plan = postings._counted(None)(dealt[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # unfolded above the only exchange
    lists = spark.read.parquet(str(tmp_path / "index/lists"))
    assert lists.selectExpr("inline(entries)").agg(F.sum("m")).first()[0] == 300 * 200
