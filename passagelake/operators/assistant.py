"""Questions to cited answers, and gold questions to answer records, as one plan over tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS, Settings
from ..functions import text as tx
from ..sources.shared import kept
from . import answers, models
from . import retrieval as r


@dataclass(frozen=True)
class Models:
    embedder: Callable[[], models.Embedder] = models.HashingEmbedder
    scorer: Callable[[], models.PairScorer] | None = models.OverlapScorer
    generator: Callable[[], models.Generator] = models.ExtractiveGenerator


def context_of(questions: DataFrame, chunks: DataFrame, used: Models, conf: Settings = SETTINGS) -> DataFrame:
    """The context of each question: question_id, marker and the chunk's columns. questions: question_id, owner_id, text; chunks have an embedding.

    The questions' vectors and the shortlist are written, so that models and searches run once and texts are joined to a table of known size.
    Texts to which the model gives a vector of length zero are found by their terms only.
    """
    asked = kept(questions.withColumn("embedding", models.embed(F.col("text"), used.embedder, query=True)), "asked")
    fused = r.rrf_fusion(r.vector_topk(r.directed(asked), r.directed(chunks), conf.candidates), r.lexical_topk(asked, chunks, conf.candidates), conf)
    found = r.hydrate(r.small(kept(fused.where(F.col("position") <= conf.shortlist), "shortlist")), asked, chunks)
    if used.scorer:
        words = questions.select("question_id", F.col("text").alias("question"))
        scored = found.join(words, "question_id").withColumn("rerank_score", models.score_pairs(F.col("question"), F.col("text"), used.scorer)).drop("question")
        order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), "position")
        found = scored.withColumn("position", F.row_number().over(order))
    return r.diversity_cap(found, conf.top_k, conf.per_document).withColumnRenamed("final_rank", "marker").withColumn("page_start", F.lit(None).cast("int"))


def answer(questions: DataFrame, context: DataFrame, history: DataFrame, used: Models, conf: Settings = SETTINGS) -> DataFrame:
    """question_id, answer and grounded. history: session_id and transcript; questions: question_id, session_id, text."""
    asked = questions.select("question_id", "session_id", F.col("text").alias("question"))
    prompts = answers.user_prompt(asked, answers.context_block(context, conf), history)
    hits = context.select("question_id").distinct()
    generated = prompts.join(hits, "question_id", "left_semi").select("question_id", models.complete(F.col("prompt"), used.generator).alias("answer"))
    return answers.answer_routing(questions, context, generated)


def answer_records(questions: DataFrame, answered: DataFrame, context: DataFrame) -> DataFrame:
    """What an audit of answers reads: contexts, their sections, and emitted and valid markers of each question."""
    rows = F.array_sort(F.collect_list(F.struct("marker", "text", tx.section_or_title(F.col("heading_path"), F.col("title")).alias("section"))))
    held = context.groupBy("question_id").agg(rows.alias("rows"))
    marks = answers.markers_of(answered, context)
    joined = questions.select("question_id", F.col("text").alias("question")).join(answered, "question_id").join(held, "question_id", "left").join(marks, "question_id")
    parts = lambda name: F.transform(F.coalesce("rows", F.array().cast("array<struct<marker:int,text:string,section:string>>")), lambda x: x[name])
    return joined.select("question_id", "question", "answer", "grounded", parts("text").alias("contexts"), parts("section").alias("context_sections"), "emitted", "valid")


def draft_questions(chunks: DataFrame, prompt: Callable, used: Models) -> DataFrame:
    """chunk_id and question: what the generator drafts for each chunk. prompt: a text column to a prompt column."""
    raw = chunks.select("chunk_id", models.complete(prompt(F.col("text")), used.generator).alias("raw"))
    return raw.select("chunk_id", F.explode(tx.parse_questions(F.col("raw"))).alias("question"))
