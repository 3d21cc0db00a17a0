"""Connected components of a link table, as rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 100


def connected_components(links: DataFrame) -> DataFrame:
    """links has columns a and b; the result gives each linked node its component's smallest node: node, component.

    Each round first points all larger neighbours of a node at its smallest neighbour, then all smaller ones, and so makes stars of chains in
    a number of rounds that grows with the logarithm of their length. Only minima are gathered per node, never its
    neighbours. Rounds are written to the shared folder. Nulls and links of a node with itself count for nothing.
    """
    edges = written(_ordered(links).distinct(), "links")
    before = _told(edges)
    for _ in range(ROUNDS):
        edges = written(_small_star(_large_star(edges)), "links")
        now = _told(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _told(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; for others but by a chance of 2 ** -64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _ordered(links: DataFrame) -> DataFrame:
    """a above b, without nulls and loops."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = _ordered(edges)
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
    moved = down.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()
