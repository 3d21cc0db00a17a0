"""Proportional stratified interleaving: every shard holds the mixture of the whole.

Rows are shuffled within their source by a seeded hash and ranked; rank k of n gets the
fraction (2k - 1) / 2n. Rows sorted by that fraction run through all sources in proportion,
so equal cuts of the sorted rows are shards of the same mixture.

Neither sort is a global one. Ranks within a source come from hash buckets: counts of each
(source, bucket) give the offsets, and only rows of one bucket are sorted together. Positions
in the whole come from fraction buckets, whose offsets are sums of their counts. A source with a third of all rows is so spread over all buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1 << 18
LEAST_BUCKETS = 512


def seeded_hash(key: Column, seed: int, instead: Column) -> Column:
    """40 bits of md5, which any SQL engine can compute as well. ``instead`` stands for a null key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), instead))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def bucket_count(rows: int) -> int:
    return 1 << max(LEAST_BUCKETS.bit_length() - 1, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET)))


def interleaved_shards(df: DataFrame, n_shards: int, source: str = "source", key: str = "doc_id", seed: int = 42, ties: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Add shard (0 to n_shards - 1) and slot (gapless from 0 in each shard) to the rows of df.

    Shard sizes differ by one row at most, and each shard's rows of a source differ from
    its share by less than two. Nulls: a null source is a source of its own, a null key hashes like ``~`` and the ties, so that rows without keys spread.
    Repeated rows each get a slot. ``ties`` are further columns that order rows of equal keys.
    Empty input gives an empty result. Columns of df keep their names, but columns ``shard`` and ``slot`` are replaced; helpers use names starting with ``_s_``.
    """
    df = df.drop("shard", "slot")
    rows = df.count()  # from Parquet footers when df is a plain scan
    buckets = buckets or bucket_count(rows)
    shift = 40 - (buckets.bit_length() - 1)
    base = df.withColumns({"_s_src": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), "_s_h": seeded_hash(F.col(key), seed, F.concat(F.lit("~"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ties)))}).withColumn("_s_b", F.shiftright("_s_h", shift))
    by_source = Window.partitionBy("_s_src")
    counts = (
        base.groupBy("_s_src", "_s_b").agg(F.count(F.lit(1)).alias("_s_c"))
        .withColumns({"_s_off": F.sum("_s_c").over(by_source.orderBy("_s_b").rowsBetween(Window.unboundedPreceding, -1)), "_s_n": F.sum("_s_c").over(by_source)})
        .select("_s_src", "_s_b", F.coalesce("_s_off", F.lit(0)).alias("_s_off"), "_s_n")
    )
    in_bucket = Window.partitionBy("_s_src", "_s_b").orderBy("_s_h", key, *ties)
    ranked = base.withColumn("_s_k", F.row_number().over(in_bucket)).join(counts, ["_s_src", "_s_b"]).withColumn("_s_k", F.col("_s_k") + F.col("_s_off"))

    # Integer arithmetic: bucket g of rank k is floor((2k - 1) * G / 2n). Offsets come from at most ``buckets`` counts.
    ranked = ranked.withColumns({"_s_g": F.expr(f"((2 * _s_k - 1) * {buckets}) div (2 * _s_n)"), "_s_f": (2 * F.col("_s_k") - 1) / (2 * F.col("_s_n"))})
    before = F.sum("_s_c").over(Window.orderBy("_s_g").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranked.groupBy("_s_g").agg(F.count(F.lit(1)).alias("_s_c")).select("_s_g", F.coalesce(before, F.lit(0)).alias("_s_start"))
    placed = ranked.withColumn("_s_p", F.row_number().over(Window.partitionBy("_s_g").orderBy("_s_f", "_s_src", "_s_k"))).join(starts, "_s_g").withColumn("_s_p", F.col("_s_p") + F.col("_s_start") - 1)
    shard = F.expr(f"(_s_p * {n_shards}) div {max(rows, 1)}")
    out = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("_s_p") - F.expr(f"(shard * {max(rows, 1)}L + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", slot.cast("long")).select(*df.columns, "shard", "slot")
