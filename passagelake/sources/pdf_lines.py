"""Sections from lines that were extracted from PDF files: columns doc_id, line_no, page, text, size, bold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions.text import strip, word_count
from .markdown import heading_path


def rounded() -> Column:
    return F.bround(F.col("size"), 1)


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id and body: the size with the most characters; of equals, the one seen first."""
    sizes = lines.groupBy("doc_id", rounded().alias("size")).agg(F.sum(F.length("text")).alias("chars"), F.min("line_no").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("first"))).alias("body"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """doc_id, size and level: the four largest sizes of those well above the body's."""
    large = lines.join(body_size(lines), "doc_id").where(F.col("size") >= F.col("body") * SETTINGS.pdf_size_ratio)
    level = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return large.select("doc_id", rounded().alias("size")).distinct().withColumn("level", level).where(F.col("level") <= SETTINGS.max_depth)


def heading_decision(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """lines with their heading level, null for body text. toc: doc_id and title."""
    levels = heading_levels(lines).select("doc_id", F.col("size").alias("_size"), F.col("level").alias("_level"))
    titles = toc.select("doc_id", F.col("title").alias("text"), F.lit(True).alias("_toc")).distinct()
    joined = lines.withColumn("_size", rounded()).join(levels, ["doc_id", "_size"], "left").join(titles, ["doc_id", "text"], "left").join(body_size(lines), "doc_id")
    bold: Column = F.col("bold") & (F.col("size") >= F.col("body")) & ~F.col("text").endswith(".")
    level = F.when(word_count(F.col("text")) > SETTINGS.pdf_heading_words, None).when(F.col("_level").isNotNull(), F.col("_level")).when(F.col("_toc") | bold, SETTINGS.max_depth)
    return joined.select(*lines.columns, level.cast("int").alias("level"))


def sections(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, section_order, heading_path (of any depth), text, page_start, page_end."""
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = heading_decision(lines, toc).withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(so_far)).withColumn("heading_path", heading_path("level", "text", so_far, SETTINGS.max_depth))
    body = F.col("level").isNull()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    found = rows.groupBy("doc_id", "section").agg(
        F.max_by("heading_path", "line_no").alias("heading_path"), strip(text).alias("text"),
        F.min_by("page", F.when(body, F.col("line_no"))).alias("page_start"), F.max_by("page", F.when(body, F.col("line_no"))).alias("page_end"),
    ).where(F.col("text") != "")
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1).alias("section_order"), "heading_path", "text", "page_start", "page_end")
