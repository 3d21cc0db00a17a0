"""Retrieval over tables of questions and chunks: both searches, their fusion, hydration, reranking and diversity.

The tenant is an equality in every join, so no cut is ever made across tenants. Ranking works on narrow rows; texts are joined
to the shortlist only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS, Settings
from ..functions import text as tx
from ..functions import vectors as vec

#: Tables of questions up to this size are broadcast; larger ones are joined by shuffle.
SMALL_ROWS = 50_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scoped(df: DataFrame, owner: str) -> DataFrame:
    return df.where(F.col("owner_id") == owner)


def top_per_question(scored: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each question with their rank from 1. Spark cuts to k in each task before the shuffle."""
    return scored.withColumn(rank, F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col(rank) <= k)


def directed(df: DataFrame) -> DataFrame:
    """Rows that dense search can find: those whose embedding isn't of length zero."""
    return df.where(vec.norm(F.col("embedding")) > 0)


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = SETTINGS.candidates) -> DataFrame:
    """question_id, chunk_id, similarity, rank: exact cosine search within the question's tenant, ties by chunk_id.

    A vector of length zero has similarity NaN, which comes first as in SQL; ``directed`` leaves such rows out.
    """
    q = small(questions.where(F.col("embedding").isNotNull()).select("question_id", "owner_id", F.col("embedding").alias("asked"), vec.norm(F.col("embedding")).alias("asked_norm")))
    c = chunks.where(F.col("embedding").isNotNull()).select("chunk_id", "owner_id", "embedding", vec.norm(F.col("embedding")).alias("own_norm"))
    similarity = vec.over_norms(vec.dot(F.col("embedding"), F.col("asked")), F.col("own_norm") * F.col("asked_norm"))
    scored = c.join(q, "owner_id").select("question_id", "chunk_id", similarity.alias("similarity"))
    return top_per_question(scored, [F.desc("similarity"), F.col("chunk_id")], k)


def words_of(analyzer: Callable[[Column], Column] | None = None) -> Column:
    """The terms of a chunk, its headings first."""
    found = tx.terms(F.concat_ws(" ", F.nullif("heading_path", F.lit("")), "text"))
    return analyzer(found) if analyzer else found


def lexical_topk(questions: DataFrame, chunks: DataFrame, k: int = SETTINGS.candidates, analyzer: Callable[[Column], Column] | None = None) -> DataFrame:
    """question_id, chunk_id, score, rank: 0.1 for each position with a term of the question, over ln(1 + positions).

    analyzer: from the terms of a text to those that count, on both sides alike; none leaves them as they are.
    """
    analyse = analyzer or (lambda c: c)
    asked = small(questions.select("question_id", "owner_id", F.explode(F.array_distinct(analyse(tx.query_terms(F.col("text"))))).alias("term")))
    words = chunks.select("chunk_id", "owner_id", words_of(analyzer).alias("words"))
    placed = words.select("chunk_id", "owner_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    matched = placed.join(asked, ["owner_id", "term"]).groupBy("question_id", "chunk_id", "n").agg(F.count(F.lit(1)).alias("m"))
    scored = matched.select("question_id", "chunk_id", (0.1 * F.col("m") / F.log(1.0 + F.col("n"))).alias("score"))
    return top_per_question(scored, [F.desc("score"), F.col("chunk_id")], k)


def rrf_fusion(dense: DataFrame, lexical: DataFrame, conf: Settings = SETTINGS) -> DataFrame:
    """question_id, chunk_id, fused_score, vector_rank, lexical_rank, position by reciprocal ranks; a rank not held is null."""
    d = dense.select("question_id", "chunk_id", F.col("rank").alias("vector_rank"))
    x = lexical.select("question_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (conf.rrf_k + F.col(c)), F.lit(0.0))
    both = d.join(x, ["question_id", "chunk_id"], "full_outer").withColumn("fused_score", part("vector_rank", conf.vector_weight) + part("lexical_rank", conf.lexical_weight))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("fused_score"), "chunk_id")))


def hydrate(shortlist: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join texts to the shortlist, checking the tenant once more. Ids that aren't there are dropped. A shortlist marked for broadcast leaves texts where they are."""
    texts = chunks.select("chunk_id", "owner_id", "document_id", "chunk_index", "title", "heading_path", "text").join(shortlist, "chunk_id")
    return texts.join(questions.select("question_id", "owner_id"), ["question_id", "owner_id"])


def overlap_score(question: Column, passage: Column) -> Column:
    """A stand-in for a cross-encoder, which isn't at hand offline: the share of the question's terms in the passage."""
    asked = tx.query_terms(question)
    return F.coalesce(F.size(F.array_intersect(asked, tx.terms(passage))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def rerank(hydrated: DataFrame, questions: DataFrame) -> DataFrame:
    """Add rerank_score and rerank_position: by that score, then the fused one, then the fused position."""
    asked = questions.select("question_id", F.col("text").alias("question"))
    scored = hydrated.join(asked, "question_id").withColumn("rerank_score", overlap_score(F.col("question"), F.col("text"))).drop("question")
    w = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), "position")
    return scored.withColumn("rerank_position", F.row_number().over(w))


def diversity_cap(ranked: DataFrame, top_k: int = SETTINGS.top_k, cap: int = SETTINGS.per_document, position: str = "position") -> DataFrame:
    """The best top_k with ``cap`` at most of a document; displaced rows fill what is left. final_rank is in the ranked order."""
    within = F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy(position))
    marked = ranked.withColumn("_displaced", (within > cap).cast("int"))
    chosen = F.row_number().over(Window.partitionBy("question_id").orderBy("_displaced", position))
    kept = marked.withColumn("_chosen", chosen).where(F.col("_chosen") <= top_k)
    final = F.row_number().over(Window.partitionBy("question_id").orderBy(position))
    return kept.withColumn("final_rank", final).drop("_displaced", "_chosen")


def retrieve(questions: DataFrame, chunks: DataFrame, conf: Settings = SETTINGS, reranked: bool = False) -> DataFrame:
    """Both searches, fused, cut, hydrated, reranked if asked for, and diversified."""
    fused = rrf_fusion(vector_topk(questions, chunks, conf.candidates), lexical_topk(questions, chunks, conf.candidates), conf)
    found = hydrate(fused.where(F.col("position") <= conf.shortlist), questions, chunks)
    if reranked:
        return diversity_cap(rerank(found, questions), conf.top_k, conf.per_document, "rerank_position")
    return diversity_cap(found, conf.top_k, conf.per_document)
