"""Markdown files as sections with heading paths.

Lines are rows; fences, headings and sections are running aggregates over them. The heading path is read off windows too: the heading of level k is on the
path if the last heading of level k or less is one of level k. A file's lines are scanned in blocks, so that a long file takes many tasks: each block is
summed up for either state of the fence before it, the sums are carried from block to block, and each block's lines then go on from what is before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions.text import LINE_END, strip

HEADING = r"(?U)^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"(?U)^\s*(```|~~~)"
LEVELS = range(1, 7)
#: Lines of a block.
BLOCK = 4096
#: Either suffix in either case.
FILES = "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and body of each Markdown file; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", FILES).option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("body"))


def decoded(content: Column) -> Column:
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.make_valid_utf8(content.cast("string"))


def lines_of(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, line_no and line; a closing line end doesn't begin another line."""
    pieces = F.split(F.coalesce(body, F.lit("")), LINE_END)
    return docs.select(key, F.posexplode(pieces).alias("line_no", "line"))


def heading_path(level: str, title: str, window, depth: int = 6):
    """The titles above and at a row, given a heading's level and title (null in other rows) in the window's order."""
    steps = []
    for k in range(1, depth + 1):
        seen = F.last(F.when(F.col(level) <= k, F.struct(F.col(level).alias("l"), F.col(title).alias("t"))), ignorenulls=True).over(window)
        steps.append(F.when(seen["l"] == k, seen["t"]))
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def scanned(docs: DataFrame, key: str, body: str, block: int = BLOCK) -> DataFrame:
    """The lines with level and title (of headings), section (headings up to the line) and heading_path."""
    rows = lines_of(docs, key, body).withColumn("block", F.floor(F.col("line_no") / block)).withColumn("fence", F.col("line").rlike(FENCE).cast("int"))
    by_block = Window.partitionBy(key, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    like = (F.col("fence") == 0) & F.col("line").rlike(HEADING)
    found = F.when(like, F.struct(F.length(F.regexp_extract("line", HEADING, 1)).alias("l"), strip(F.regexp_extract("line", HEADING, 2)).alias("t")))
    #: What looks like a heading is one if as many fences are before the block, by parity, as within it before the line.
    rows = rows.withColumn("like", found).withColumn("state", F.sum("fence").over(by_block) % 2)
    last = lambda state, k: F.max_by(F.when((F.col("state") == state) & (F.col("like.l") <= k), F.col("like")), F.when((F.col("state") == state) & (F.col("like.l") <= k), F.col("line_no")))
    sums = [F.sum("fence").alias("fences"), *(F.count(F.when(F.col("state") == s, F.col("like"))).alias(f"n{s}") for s in (0, 1)), *(last(s, k).alias(f"last{s}_{k}") for s in (0, 1) for k in LEVELS)]
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "block").agg(*sums).withColumn("parity", F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2)
    held = lambda name: F.when(F.col("parity") == 0, F.col(name.format(0))).otherwise(F.col(name.format(1)))
    carried = [F.coalesce(F.sum(held("n{}")).over(before), F.lit(0)).alias("sections"), *(F.last(held(f"last{{}}_{k}"), ignorenulls=True).over(before).alias(f"above{k}") for k in LEVELS)]
    rows = rows.join(blocks.select(key, "block", "parity", *carried), [key, "block"]).withColumn("heading", F.when(F.col("state") == F.col("parity"), F.col("like")))
    steps = []
    for k in LEVELS:
        seen = F.coalesce(F.last(F.when(F.col("heading.l") <= k, F.col("heading")), ignorenulls=True).over(by_block), F.col(f"above{k}"))
        steps.append(F.when(seen["l"] == k, seen["t"]))
    section = (F.col("sections") + F.count("heading").over(by_block)).alias("section")
    return rows.select(key, "line_no", "line", F.col("heading.l").alias("level"), F.col("heading.t").alias("title"), section, F.filter(F.array(*steps), lambda x: x.isNotNull()).alias("heading_path"))


def sections(docs: DataFrame, key: str = "path", body: str = "body", block: int = BLOCK) -> DataFrame:
    """key, section_order, heading_path (MAX depth), text of the sections that have any. A section's text is one value, however long the section."""
    rows = scanned(docs, key, body, block).withColumn("heading_path", F.slice("heading_path", 1, SETTINGS.max_depth))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    found = rows.groupBy(key, "section").agg(F.max_by("heading_path", "line_no").alias("heading_path"), strip(text).alias("text")).where(F.col("text") != "")
    order = F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1
    return found.select(key, order.alias("section_order"), "heading_path", "text")
