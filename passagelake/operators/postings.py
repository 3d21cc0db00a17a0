"""A kept inverted index for lexical search: rows of postings by tenant, term and block of chunks, with the largest score of each.

Blocks hold chunks of like length, the same for all terms of a segment, so the sum of a question's largest scores bounds all chunks of a block. A search reads
these sums first, scores the most promising blocks, and then only those whose bound reaches the k-th score so far: the result is that of retrieval.lexical_topk,
and no text is read.

An index is a folder of segments. An update writes a segment of its own and names the documents whose older postings no longer count; a segment counts
once it is published, so a write that failed is never seen. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions import text as tx
from ..sources.shared import kept
from .retrieval import small, top_per_question, words_of

#: Chunks to a block, blocks to a run of files and to a task that counts terms, folders of terms, and the blocks of a question that are scored to find its threshold.
BLOCK, RUN, PACK, BUCKETS, FIRST = 512, 8, 4, 64, 2
#: Names of blocks (three numbers) up to this number are broadcast.
BLOCK_ROWS = 1_000_000
#: Sums of rounded bounds may fall short of the true one by less than this factor.
SLACK = 1 + 1e-9
LISTS = "owner_id string, term string, block long, best double, entries array<struct<chunk_id: string, document_id: string, m: long, n: long>>, segment int, bucket int"

Analyzer = Callable[[Column], Column]


def score_of(m: Column, n: Column) -> Column:
    return 0.1 * m / F.log(1.0 + n)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("owner_id", "term"), F.lit(buckets)).cast("int")


def published(spark: SparkSession, path: str) -> list[Row]:
    """The segments that count (segment, base, buckets), in order: one row an update since the last merge."""
    found = spark.read.schema("base int, buckets int, segment int").option("basePath", f"{path}/published").parquet(f"{path}/published").collect()
    base = max(r["base"] for r in found)
    return sorted((r for r in found if r["segment"] >= base), key=lambda r: r["segment"])


def _placed(chunks: DataFrame) -> DataFrame:
    """owner_id, document_id, chunk_id, size (a class of lengths), heading_path and text of all chunks."""
    known = chunks.where(F.col("owner_id").isNotNull() & F.assert_true(F.col("chunk_id").isNotNull(), F.lit("a chunk without id")).isNull())
    size = _length_class(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")
    return known.select("owner_id", F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), size, "heading_path", "text")


def _counted(analyzer: Analyzer | None) -> Callable[[DataFrame], DataFrame]:
    """n (terms of the chunk), term and m (its places) of chunks, each of which is in one task with its block."""

    def run(dealt: DataFrame) -> DataFrame:
        words = dealt.select("owner_id", "block", "chunk_id", "document_id", words_of(analyzer).alias("words"))
        each = words.select("owner_id", "block", "chunk_id", "document_id", F.size("words").cast("long").alias("n"), F.explode("words").alias("term"))
        return each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("m"))

    return run


def _length_class(length: Column) -> Column:
    """Classes a sixteenth of a logarithm wide, of which there are some hundreds at most."""
    return F.floor(F.log(1.0 + length) * 16).cast("int")


def _store(placed: DataFrame, sizes: DataFrame, unfold: Callable[[DataFrame], DataFrame], path: str, segment: int, base: int, buckets: int, block: int) -> None:
    """Write and publish a segment. A chunk's place among those of its length is by hash, so no task sorts a tenant's chunks and blocks are of about one size.

    Rows are dealt by block, in tasks of some ``PACK`` blocks, and unfolded to terms only there; what is dealt once more, by bucket and run of blocks for the files, are the finished lists.
    """
    spark, keys = placed.sparkSession, ["bucket", "owner_id", "term", "block"]
    before = F.expr("sum(alike) over (partition by owner_id order by size rows between unbounded preceding and 1 preceding)")  # a row a class
    lengths = sizes.groupBy("owner_id", "size").agg(F.count(F.lit(1)).alias("alike"))
    starts = kept(lengths.select("owner_id", "size", "alike", F.coalesce(before, F.lit(0)).alias("start")), "lengths")
    tasks = -(-(starts.agg(F.sum("alike")).first()[0] or 1) // (block * PACK))
    place = F.col("start") + F.pmod(F.xxhash64("chunk_id"), F.col("alike"))
    dealt = placed.join(small(starts), ["owner_id", "size"]).withColumn("block", F.floor(place / block)).drop("size", "start", "alike").repartition(tasks, "owner_id", "block")
    counted = unfold(dealt).withColumn("bucket", _bucket(buckets))
    entry = F.struct("chunk_id", "document_id", "m", "n")
    lists = counted.groupBy(*keys).agg(F.max(score_of(F.col("m"), F.col("n"))).alias("best"), F.collect_list(entry).alias("entries"))
    filed = lists.repartition("bucket", F.floor(F.col("block") / RUN))
    filed.sortWithinPartitions("bucket", "owner_id", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists/segment={segment}")
    spark.createDataFrame([(base, buckets)], "base int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/published/segment={segment}")


def _store_chunks(chunks: DataFrame, analyzer: Analyzer | None, path: str, segment: int, base: int, buckets: int, block: int) -> None:
    placed = _placed(chunks)
    _store(placed, placed, _counted(analyzer), path, segment, base, buckets, block)


def build_postings(chunks: DataFrame, path: str, analyzer: Analyzer | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Index chunks (chunk_id, owner_id, document_id, heading_path, text) into a new folder.

    A chunk_id stands for one row of its tenant. Rows without tenant, which no question finds, and those without terms leave nothing; a null chunk_id is an error. No rows give an empty index.
    """
    _store_chunks(chunks, analyzer, path, 0, 0, buckets, block)


def update_documents(chunks: DataFrame, documents: DataFrame, path: str, analyzer: Analyzer | None = None, block: int = BLOCK) -> None:
    """Let chunks take the place of all that the index holds of ``documents`` (owner_id, document_id); documents without chunks are deleted. Null documents are one of their own."""
    last = published(chunks.sparkSession, path)[-1]
    segment = last["segment"] + 1
    named = documents.select("owner_id", F.col("document_id").cast("string").alias("document_id")).distinct()
    named.write.mode("overwrite").parquet(f"{path}/dropped/segment={segment}")
    _store_chunks(chunks, analyzer, path, segment, last["base"], last["buckets"], block)


def merge_segments(spark: SparkSession, path: str, block: int = BLOCK) -> None:
    """One segment of what counts. The older ones are left for running searches and may be deleted afterwards."""
    segments = published(spark, path)
    live = _live(_lists(spark, path, segments).select("owner_id", "segment", "term", F.inline("entries")), path, segments)
    segment = segments[-1]["segment"] + 1
    sized = live.select("owner_id", "document_id", "chunk_id", "n", "term", "m", _length_class(F.col("n")).alias("size"))
    _store(sized, sized.select("owner_id", "chunk_id", "size").distinct(), lambda dealt: dealt, path, segment, segment, segments[-1]["buckets"], block)


def _lists(spark: SparkSession, path: str, segments: list[Row]) -> DataFrame:
    return spark.read.schema(LISTS).option("basePath", f"{path}/lists").parquet(*(f"{path}/lists/segment={r['segment']}" for r in segments))


def _live(entries: DataFrame, path: str, segments: list[Row]) -> DataFrame:
    """Entries (owner_id, document_id, segment) whose document no later segment has replaced."""
    if len(segments) == 1:
        return entries
    told = entries.sparkSession.read.schema("owner_id string, document_id string, segment int").option("basePath", f"{path}/dropped").parquet(*(f"{path}/dropped/segment={r['segment']}" for r in segments[1:]))
    d = told.groupBy("owner_id", "document_id").agg(F.max("segment").alias("_upto")).select(F.col("owner_id").alias("_owner"), F.col("document_id").alias("_document"), "_upto")
    gone = (F.col("owner_id") == F.col("_owner")) & F.col("document_id").eqNullSafe(F.col("_document")) & (F.col("segment") < F.col("_upto"))
    return entries.join(d, gone, "left_anti")


class Search:
    """The steps of one search; bounds and blocks are open to tests."""

    def __init__(self, questions: DataFrame, path: str, analyzer: Analyzer | None = None) -> None:
        spark, self.path = questions.sparkSession, path
        self.segments = published(spark, path)
        self.lists = _lists(spark, path, self.segments)
        terms = tx.query_terms(F.col("text"))
        asked = questions.select("question_id", "owner_id", F.explode(F.array_distinct(analyzer(terms)) if analyzer else terms).alias("term"))
        self.asked = small(asked.withColumn("bucket", _bucket(self.segments[-1]["buckets"])))

    def bounds(self) -> DataFrame:
        """question_id, segment, block and bound: no chunk of the block scores higher. Entries aren't read."""
        met = self.lists.select("owner_id", "term", "bucket", "segment", "block", "best").join(self.asked, ["owner_id", "bucket", "term"])
        return met.groupBy("question_id", "segment", "block").agg((F.sum("best") * SLACK).alias("bound"))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """question_id, chunk_id and score of all chunks of these blocks (question_id, segment, block) with a term of the question."""
        named, terms, at = blocks.select("question_id", "segment", "block"), ["owner_id", "bucket", "term"], ["segment", "block"]
        told, lists = small(named, BLOCK_ROWS), self.lists.drop("best")
        # Lists stay where they are while the names of the blocks can be sent to them, which have no terms and so are far fewer than the rows wanted.
        found = lists.join(small(self.asked.join(named, "question_id")), [*terms, *at]) if told is named else lists.join(self.asked, terms).join(told, ["question_id", *at])
        met = found.select("question_id", "owner_id", "segment", F.inline("entries"))
        total = _live(met, self.path, self.segments).groupBy("question_id", "chunk_id", "n").agg(F.sum("m").alias("m"))
        return total.select("question_id", "chunk_id", score_of(F.col("m"), F.col("n")).alias("score"))

    def blocks(self, bounds: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """The bounds that reach the question's k-th score over its ``first`` best blocks; all where these hold fewer than k."""
        promising = top_per_question(bounds, [F.desc("bound"), F.col("segment"), F.col("block")], first, "place")
        ranked = top_per_question(self.scores(promising), [F.desc("score"), F.col("chunk_id")], k)
        least = ranked.where(F.col("rank") == k).select("question_id", F.col("score").alias("least"))
        return bounds.join(least, "question_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select(*bounds.columns)


def lexical_topk_index(questions: DataFrame, path: str, k: int = SETTINGS.candidates, analyzer: Analyzer | None = None, first: int = FIRST) -> DataFrame:
    """As retrieval.lexical_topk, from the index: question_id, chunk_id, score, rank. analyzer is the one that the index was built with."""
    search = Search(questions, path, analyzer)
    bounds = kept(search.bounds(), "bounds")
    found = search.scores(kept(search.blocks(bounds, k, first), "blocks"))
    return top_per_question(found, [F.desc("score"), F.col("chunk_id")], k)
