"""Latency by stage, levels of requests, and the sliding-window limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import SETTINGS

QUIET = ("/health/live", "/health/ready")


def stage_totals(stages: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """request_id, stage, place, total_ms (an exact sum, to a tenth) and n; stages that aren't listed come after those that are."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    sums = stages.groupBy("request_id", "stage").agg(F.bround(F.sum(F.col("elapsed_ms").cast("decimal(20,6)")), 1).cast("double").alias("total_ms"), F.count(F.lit(1)).alias("n"))
    return sums.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def unattributed(totals: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and the part of its total that no stage accounts for, 0 at least."""
    measured = totals.groupBy("request_id").agg(F.sum("total_ms").alias("measured"))
    return requests.join(measured, "request_id", "left").select("request_id", F.greatest(F.col("total_ms") - F.coalesce("measured", F.lit(0.0)), F.lit(0.0)).alias("unattributed_ms"))


def request_level(status: Column, ms: Column) -> Column:
    return F.when(status >= 500, "error").when(ms >= SETTINGS.slow_ms, "warning").otherwise("info")


def logged(requests: DataFrame) -> DataFrame:
    """Requests that are logged, with their level: healthy probes are quiet."""
    quiet = F.col("path").isin(*QUIET) & (F.col("status") < 400)
    return requests.where(~quiet).withColumn("level", request_level(F.col("status"), F.col("duration_ms")))


def admit(times: list[float], kinds: list[str], hits: list[float], most: int, window: float) -> tuple[list[bool], list[int | None], list[float]]:
    """Decide attempts of one key in order. A refused attempt isn't recorded; a reset forgets the key's history."""
    allowed: list[bool] = []
    retry: list[int | None] = []
    for at, kind in zip(times, kinds):
        hits = [] if kind == "reset" else [h for h in hits if at - h <= window]
        ok = kind == "reset" or len(hits) < most
        allowed.append(ok)
        retry.append(None if ok else int(window - (at - hits[0])) + 1)
        if ok and kind != "reset":
            hits.append(at)
    return allowed, retry, hits


def rate_limit(attempts: DataFrame, most: int, window: float) -> DataFrame:
    """attempts (key, seq, t, kind) with allowed and retry_after. A key's attempts stream through one task in order; ``most`` times are kept, never its history. A null key counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = None, []
        for pdf in batches:
            parts = []
            for k, g in pdf.groupby("key", sort=False):
                if k != key:
                    key, hits = k, []
                allowed, retry, hits = admit(g["t"].tolist(), g["kind"].tolist(), hits, most, window)
                parts.append(g.assign(allowed=allowed, retry_after=pd.array(retry, dtype="Int64")))
            if parts:
                yield pd.concat(parts)

    rows = attempts.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "seq", F.col("t").cast("double").alias("t"), "kind")
    dealt = rows.repartition("key").sortWithinPartitions("key", "t", "seq")
    return dealt.mapInPandas(run, f"key string, seq {rows.schema['seq'].dataType.simpleString()}, t double, kind string, allowed boolean, retry_after bigint")
