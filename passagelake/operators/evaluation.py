"""Retrieval metrics, their intervals, percentiles and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions.text import section_matches
from ..sources.shared import kept


def first_relevant_rank(ranked: DataFrame) -> DataFrame:
    """config, question_id and rank (null: none) of the first row whose section holds the expected one."""
    hit = F.when(section_matches(F.col("section"), F.col("expected")), F.col("rank"))
    return ranked.groupBy("config", "question_id").agg(F.min(hit).alias("rank"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / rank, F.lit(0.0))


def ndcg(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def ir_metrics(outcomes: DataFrame, k: int = SETTINGS.top_k) -> DataFrame:
    """For each config: n, hits, hit_rate, mrr and ndcg over outcomes with a rank."""
    hit = F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))
    return outcomes.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(hit).alias("hit_rate"), F.avg(reciprocal(F.col("rank"))).alias("mrr"), F.avg(ndcg(F.col("rank"), k)).alias("ndcg"))


def wilson(hits: Column, n: Column, z: float = SETTINGS.wilson_z) -> tuple[Column, Column]:
    """Bounds of Wilson's interval, within 0 and 1; zeros without trials."""
    n = F.nullif(n, F.lit(0)).cast("double")
    p = hits / n
    scale = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = n.isNotNull()  # greatest and least pass over nulls
    return F.when(some, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), F.when(some, F.least(middle + half, F.lit(1.0))).otherwise(0.0)


#: Buckets that a pass counts for each group and share, and the rows that are at last put in order.
BUCKETS, SORTED_ROWS = 1024, 20_000


def percentiles(df: DataFrame, group: str, value: str, *shares: float) -> DataFrame:
    """Nearest-rank percentiles p50, p95 and so on of each group; 0 without values.

    Exact, with BUCKETS counts of a group in a task: a pass counts values by bucket between the least and the largest that are left, and keeps the bucket in which
    the wanted rank lies, until that holds one value or SORTED_ROWS rows. Infinities have buckets of their own; NaN counts as the largest.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    held, inf = rows.where(F.col("v").isNotNull()), F.lit(math.inf)
    finite = F.when(F.abs("v") < inf, F.col("v"))
    state = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    state = state.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"), F.lit(0).cast("long").alias("below"))
    state = state.withColumn("rank", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)))
    whole, by_bucket = True, Window.partitionBy("g", "share").orderBy("bucket")
    while True:
        state = kept(state, "percentiles")
        if not whole and state.where((F.col("n") > SORTED_ROWS) & ~F.col("lo").eqNullSafe(F.col("hi"))).isEmpty():
            break
        # Halves, as the whole range may be beyond a double's.
        part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS)
        inside = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(part, F.lit(BUCKETS - 1)))
        bucket = F.when(F.isnan("v"), BUCKETS + 1).when(F.col("v") == inf, BUCKETS).when(F.col("v") == -inf, -1).otherwise(inside) if whole else inside
        left = held.join(state.drop("n").withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
        left = left if whole else left.where(F.col("v").between(F.col("lo"), F.col("hi")))
        counted = left.groupBy("g", "share", "rank", "below", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = counted.withColumn("upto", F.col("below") + F.sum("n").over(by_bucket))
        state = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("g", "share", "rank", (F.col("upto") - F.col("n")).alias("below"), "n", "lo", "hi")
        whole = False
    few = state.where(~F.col("lo").eqNullSafe(F.col("hi"))).select(F.col("g").alias("_g"), "share", "rank", "below", "lo", "hi")
    order = F.row_number().over(Window.partitionBy("_g", "share").orderBy("v"))
    last = held.join(few, F.col("g").eqNullSafe(F.col("_g")) & F.col("v").between(F.col("lo"), F.col("hi"))).withColumn("at", order + F.col("below"))
    last = last.where(F.col("at") == F.col("rank")).select("g", "share", "v")
    found = state.where(F.col("lo").eqNullSafe(F.col("hi"))).select("g", "share", F.col("lo").alias("v")).unionByName(last)
    each = found.unionByName(rows.select("g").distinct().select("g", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("v")))
    return each.groupBy(F.col("g").alias(group)).agg(*(F.coalesce(F.max(F.when(F.col("share") == f, F.col("v"))), F.lit(0.0)).alias(f"p{round(f * 100)}") for f in shares))


def all_referenced(answers: DataFrame, reference: str, *group: str) -> DataFrame:
    """Whether all answers have a reference, for each group or, without one, in one row; true for no answers."""
    has = F.coalesce(F.col(reference) != "", F.lit(False))
    return answers.groupBy(*group).agg(F.coalesce(F.bool_and(has), F.lit(True)).alias("referenced"))


def delta_points(metrics: DataFrame, baseline: str) -> DataFrame:
    """Add delta: the hit rate's difference from the baseline's in points, as text."""
    base = F.max(F.when(F.col("config") == baseline, F.col("hit_rate"))).over(Window.partitionBy(F.lit(1)))  # a row a config
    text = F.format_string("%+.1f pp", (F.col("hit_rate") - base) * 100)
    return metrics.withColumn("delta", F.when(F.col("config") == baseline, "baseline").otherwise(text))


def report_lines(metrics: DataFrame) -> DataFrame:
    """config and its line of the report's table, from hit_rate, ci_low, ci_high, mrr, ndcg and delta."""
    pct = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    cells = ["config", F.concat(F.lit("**"), pct("hit_rate"), F.lit("**")), F.concat(pct("ci_low"), F.lit("–"), pct("ci_high")), F.format_string("%.3f", "mrr"), F.format_string("%.3f", "ndcg"), "delta"]
    return metrics.select("config", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
