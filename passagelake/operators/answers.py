"""Context blocks, prompts, answers and their citations.

``context`` tables have question_id, marker (from 1) and the chunk's columns; ``answers`` have question_id and answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import NO_CONTEXT, SETTINGS, Settings
from ..functions import text as tx


def context_rows(context: DataFrame, conf: Settings = SETTINGS) -> DataFrame:
    """The blocks that fit: each row's block in order until the first that overflows. Separators don't count."""
    label = tx.source_label(F.col("title"), F.col("heading_path"), F.col("page_start"))
    block = F.concat(F.lit("["), F.col("marker").cast("string"), F.lit("] "), label, F.lit("\n"), tx.snippet(F.col("text"), conf.snippet_chars))
    used = F.sum(F.length("block")).over(Window.partitionBy("question_id").orderBy("marker").rowsBetween(Window.unboundedPreceding, 0))
    return context.withColumn("block", block).withColumn("used", used).where(F.col("used") <= conf.context_chars)


def context_block(context: DataFrame, conf: Settings = SETTINGS) -> DataFrame:
    """question_id, context and n_blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("marker", "block")))
    return context_rows(context, conf).groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_blocks"))


def recent_history(messages: DataFrame, turns: int = SETTINGS.history_turns) -> DataFrame:
    """The last 2 x turns messages of a session, in order. messages: session_id, position, role, content."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("position")))
    return messages.withColumn("_last", last).where(F.col("_last") <= 2 * turns).drop("_last")


def transcripts(messages: DataFrame) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("position", F.concat_ws(": ", "role", "content").alias("line"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))


def user_prompt(questions: DataFrame, contexts: DataFrame, history: DataFrame) -> DataFrame:
    """question_id and prompt. questions: question_id, session_id, question; history: session_id, transcript."""
    joined = questions.join(contexts, "question_id", "left").join(history, "session_id", "left")
    parts = [F.concat(F.lit("CONVERSATION SO FAR:\n"), F.nullif("transcript", F.lit(""))), F.concat(F.lit("CONTEXT:\n"), F.coalesce("context", F.lit(""))), F.concat(F.lit("QUESTION:\n"), "question")]
    return joined.select("question_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def session_titles(messages: DataFrame, most: int = SETTINGS.title_chars) -> DataFrame:
    """session_id and title: the beginning of the first question."""
    first = messages.where(F.col("role") == "user").groupBy("session_id").agg(F.min_by("content", "position").alias("q"))
    return first.select("session_id", tx.snippet(F.col("q"), most).alias("title"))


def answer_routing(questions: DataFrame, context: DataFrame, generated: DataFrame) -> DataFrame:
    """question_id, answer and grounded: questions without context get the fixed answer."""
    hits = context.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    joined = questions.select("question_id").join(hits, "question_id", "left").join(generated, "question_id", "left")
    grounded = F.coalesce(F.col("n"), F.lit(0)) > 0
    return joined.select("question_id", F.when(grounded, F.col("answer")).otherwise(NO_CONTEXT).alias("answer"), grounded.alias("grounded"))


def markers_of(answers: DataFrame, context: DataFrame, strict: bool = False, conf: Settings = SETTINGS) -> DataFrame:
    """question_id, emitted and valid markers. Valid are 1 to the number of chunks; strict counts only those whose block was sent."""
    sent = context_rows(context, conf) if strict else context
    n = sent.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    joined = answers.join(n, "question_id", "left").withColumn("emitted", tx.citation_markers(F.col("answer")))
    return joined.select("question_id", "emitted", tx.valid_markers(F.col("emitted"), F.coalesce("n", F.lit(0))).alias("valid"))


def build_citations(answers: DataFrame, context: DataFrame, conf: Settings = SETTINGS) -> DataFrame:
    """A row for each marker of an answer that a chunk has, in the order of appearance."""
    emitted = answers.select("question_id", F.posexplode(tx.citation_markers(F.col("answer"))).alias("position", "marker"))
    section = tx.section_or_title(F.col("heading_path"), F.col("title")).alias("section")
    found = emitted.join(context, ["question_id", "marker"])
    return found.select("question_id", "position", "marker", "document_id", F.col("title").alias("document_title"), section, F.col("page_start").alias("page"), "chunk_id", tx.snippet(F.col("text"), conf.snippet_chars).alias("snippet"))


def orphan_markers(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Markers of answers without a chunk."""
    emitted = answers.select("question_id", F.explode(tx.citation_markers(F.col("answer"))).alias("marker"))
    return emitted.join(context.select("question_id", "marker"), ["question_id", "marker"], "left_anti")


def citations_json(citations: DataFrame) -> DataFrame:
    """question_id and the citations as one JSON array."""
    fields = ["marker", "document_id", "document_title", "section", "page", "chunk_id", "snippet"]
    rows = F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("c"))))
    return citations.groupBy("question_id").agg(F.to_json(F.transform(rows, lambda x: x["c"])).alias("citations"))


def citation_metrics(records: DataFrame) -> DataFrame:
    """One row over records with arrays emitted and valid; zeros without records."""
    wrong = F.size(tx.hallucinated(F.col("emitted"), F.col("valid")))
    sums = records.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("emitted")), F.lit(0)).alias("emitted_marker_count"), F.coalesce(F.sum(wrong), F.lit(0)).alias("hallucinated_marker_count"),
        F.coalesce(F.sum((F.size("valid") > 0).cast("int")), F.lit(0)).alias("cited"), F.coalesce(F.sum(F.size("valid")), F.lit(0)).alias("valid_total"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return sums.select(
        ratio("cited", "n").alias("answers_with_citations"), ratio("valid_total", "n").alias("mean_citations_per_answer"),
        ratio("hallucinated_marker_count", "emitted_marker_count").alias("hallucinated_marker_rate"), "hallucinated_marker_count", "emitted_marker_count",
    )
