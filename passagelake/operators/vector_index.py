"""An inverted-file index for dense search: unit vectors in lists round centroids, by tenant.

Centroids are fitted by k-means over a sample of the rows, in rounds of one aggregation each; every row is then put into the list of its nearest centroid. Lists
are folders (owner_id, list), so a search reads only the lists that it probes. What is found is ranked by exact similarity; what a search can miss is
rows in lists that it doesn't probe.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import SETTINGS
from ..functions import vectors as vec
from ..sources.shared import kept
from .retrieval import small, top_per_question

ROUNDS = 6
#: Rows of the sample to a centroid, and the bytes that all tenants' centroids may take: beyond that, tenants get fewer lists.
SAMPLE_PER_LIST, CENTROID_BYTES = 64, 64 << 20
PROBES = 4

Centroids = dict[str, np.ndarray]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def assigned(batch: pa.RecordBatch, centroids: Centroids, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, numbers of the nearest centroids, and vectors."""
    owners, x = batch.column("owner_id").to_numpy(zero_copy_only=False).astype(object), _matrix(batch.column("unit"), size)
    nearest = np.zeros(len(x), np.int32)
    for owner in set(owners.tolist()):
        rows = np.flatnonzero(owners == owner)
        nearest[rows] = (x[rows] @ centroids[owner].T).argmax(1)
    return owners, nearest, x


def _round(rows: DataFrame, centroids: Centroids, size: int) -> Centroids:
    """Centroids moved to the means of their rows. Tasks send sums by list; a list without rows stays where it is."""
    names = [f"v{j}" for j in range(size)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {owner: np.zeros(c.shape) for owner, c in centroids.items()}
        for batch in batches:
            owners, nearest, x = assigned(batch, centroids, size)
            for owner in set(owners.tolist()):
                at = owners == owner
                np.add.at(total[owner], nearest[at], x[at])
        for owner, t in total.items():
            some = np.flatnonzero(t.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([owner] * len(some), pa.string()), pa.array(some.astype(np.int32)), *(pa.array(t[some, j]) for j in range(size))], names=["owner_id", "list", *names])

    schema = "owner_id string, list int, " + ", ".join(f"{n} double" for n in names)
    moved = {owner: c.copy() for owner, c in centroids.items()}
    for owner, number, *values in rows.mapInArrow(sums, schema).groupBy("owner_id", "list").agg(*(F.sum(n) for n in names)).collect():
        length = math.sqrt(sum(v * v for v in values))
        if length:
            moved[owner][number] = np.array(values) / length
    return moved


def fit_centroids(units: DataFrame, size: int, rounds: int = ROUNDS) -> Centroids:
    """About the square root of each tenant's rows as centroids, fitted on a sample that is chosen by hash."""
    owners = {r["owner_id"]: r["n"] for r in units.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {o: max(1, round(math.sqrt(n))) for o, n in owners.items()}
    scale = min(1.0, CENTROID_BYTES / max(1, 8 * size * sum(wanted.values())))
    wanted = {o: max(1, int(w * scale)) for o, w in wanted.items()}
    told = units.sparkSession.createDataFrame([(o, n, wanted[o]) for o, n in owners.items()], "owner_id string, n long, lists int")
    drawn = units.join(told, "owner_id").withColumn("draw", F.pmod(F.xxhash64("chunk_id"), F.col("n")))
    sample = kept(drawn.where(F.col("draw") < SAMPLE_PER_LIST * F.col("lists")).select("owner_id", "unit"), "sample")
    starts: dict[str, list] = {}
    for r in drawn.where(F.col("draw") < 2 * F.col("lists") + 8).select("owner_id", "chunk_id", "unit").orderBy("owner_id", F.xxhash64("chunk_id", F.lit(1)), "chunk_id").collect():
        starts.setdefault(r["owner_id"], []).append(r["unit"])
    centroids = {o: np.array(starts.get(o, [[0.0] * size])[: wanted[o]], np.float64) for o in owners}
    for _ in range(rounds):
        centroids = _round(sample, centroids, size)
    return centroids


def build_index(chunks: DataFrame, path: str, rounds: int = ROUNDS) -> None:
    """Write the lists (chunk_id, unit; by owner_id and list) and the centroids of all chunks that have a vector.

    Vectors have one length; those of another, and rows without id or tenant, are refused by an error when lists are written. No rows give an empty index.
    """
    units = kept(chunks.where(F.col("embedding").isNotNull()).select("chunk_id", "owner_id", vec.l2_normalised(F.col("embedding")).alias("unit")), "units")  # read by each of the passes below
    size = units.select(F.size("unit").alias("n")).agg(F.max("n")).first()[0] or 1
    fits = (F.size("unit") == size) & F.col("chunk_id").isNotNull() & F.col("owner_id").isNotNull()
    units = units.where(F.assert_true(fits, F.lit("a vector of another size, or a row without id or tenant")).isNull())
    centroids = fit_centroids(units, size, rounds)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = assigned(batch, centroids, size)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[*batch.schema.names, "list"])

    lists = units.mapInArrow(listed, "chunk_id string, owner_id string, unit array<double>, list int")
    lists.repartition("owner_id", "list").write.partitionBy("owner_id", "list").parquet(f"{path}/lists")
    rows = [(o, i, v.tolist()) for o, c in centroids.items() for i, v in enumerate(c)]
    chunks.sparkSession.createDataFrame(rows, "owner_id string, list int, centroid array<double>").write.parquet(f"{path}/centroids")


def probed_lists(questions: DataFrame, spark: SparkSession, path: str, probes: int) -> DataFrame:
    """question_id, owner_id, list and asked (the unit vector): the lists whose centroids are nearest to the question's."""
    asked = questions.where(F.col("embedding").isNotNull()).select("question_id", "owner_id", vec.l2_normalised(F.col("embedding")).alias("asked"))
    near = asked.join(spark.read.parquet(f"{path}/centroids"), "owner_id").withColumn("near", vec.dot(F.col("asked"), F.col("centroid")))
    return top_per_question(near, [F.desc("near"), F.col("list")], probes, "probe").select("question_id", "owner_id", "list", "asked")


def vector_topk_index(questions: DataFrame, path: str, k: int = SETTINGS.candidates, probes: int = PROBES) -> DataFrame:
    """As retrieval.vector_topk, over the probed lists only: question_id, chunk_id, similarity, rank. Other lists' files aren't read."""
    spark = questions.sparkSession
    probe = small(probed_lists(questions, spark, path, probes))
    lists = spark.read.option("basePath", f"{path}/lists").schema("chunk_id string, unit array<double>, owner_id string, list int").parquet(f"{path}/lists")
    scored = lists.join(probe, ["owner_id", "list"]).select("question_id", "chunk_id", vec.dot(F.col("unit"), F.col("asked")).alias("similarity"))
    return top_per_question(scored, [F.desc("similarity"), F.col("chunk_id")], k)
