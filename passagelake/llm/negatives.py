"""Hard negatives by exact search: partial products of leading principal components, bounds on the rest, integer products of what is left.

Rows are rotated by the eigenvectors of their second moments, so that most of a product lies in few components. After the leading m of them a product
differs from its partial sum by at most the product of both residual norms (Cauchy-Schwarz) and a slack for rounding and for a rotation that isn't quite
orthogonal. Pairs whose bound can't reach the k-th best score so far are discarded; survivors are decided by products of the integers themselves.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows and anchors of a block of the grid, and the least number of blocks of rows.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_BLOCKS = 8192, 1024, 32
#: Rows that are compared at once.
CHUNK = 1024
#: Shares of the components after which pairs are discarded; the last stage has them all, and only the slack.
STAGES = (0.25, 0.5, 1.0)
LEAST = -(1 << 62)


def quantised(vector: Column, size: int) -> Column:
    """floor(256*x) of each component, as integers; those beyond what a sum of ``size`` products can hold in a long are set to that bound."""
    most = math.isqrt((1 << 62) // max(size, 1))
    most = min(most, (1 << 31) - 1)
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(most)), F.lit(-most)).cast("int"))


def usable(vector: Column) -> Column:
    """True where no component is null, infinite or not a number."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of int64; shorter lists are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    lengths, out = np.diff(column.offsets.to_numpy()), np.zeros((len(column), size), np.int64)
    out[np.arange(size)[None, :] < lengths[:, None]] = column.flatten().to_numpy()
    return out


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the second moments of all rows, the largest first. Moments are summed by component on Spark: size*size sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = matrix(batch.column("x"), size).astype(float)
            total += x.T @ x
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    total = np.zeros((size, size))
    for i, j, value in vectors.select("x").mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = total[j, i] = value
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


class Side:
    """Rows of one side: integers, rotated components, and norms of what remains after each stage."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, turn: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.y = x.astype(float) @ turn
        self.norm = np.sqrt((self.y**2).sum(1))
        self.cuts = sorted({max(1, math.ceil(share * len(turn))) for share in STAGES})
        self.rest = {m: np.sqrt((self.y[:, m:] ** 2).sum(1)) for m in self.cuts}

    def take(self, at: np.ndarray | slice) -> Side:
        part = object.__new__(Side)
        part.ids, part.labels, part.x, part.y, part.norm, part.cuts = self.ids[at], self.labels[at], self.x[at], self.y[at], self.norm[at], self.cuts
        part.rest = {m: r[at] for m, r in self.rest.items()}
        return part


def slack_of(turn: np.ndarray) -> float:
    """Times both norms: the most that rounding and the rotation add to a product."""
    return float(np.linalg.norm(turn.T @ turn - np.eye(len(turn)))) + 64 * len(turn) * 2.0**-53


def bounds(a: Side, b: Side, alive: np.ndarray, slack: float, reach: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of b that no pair has discarded, which pairs are alive, and the lowest and highest products these can have."""
    at, before, partial = np.arange(len(b.ids)), 0, np.zeros(alive.shape)
    for m in a.cuts:
        partial = partial + a.y[:, before:m] @ b.y[at, before:m].T
        spread = np.outer(a.rest[m], b.rest[m][at]) + slack * np.outer(a.norm, b.norm[at])
        low, high = partial - spread, partial + spread
        alive = alive & (high >= reach[:, None]) & (low <= most[:, None])
        kept, before = alive.any(0), m
        if not kept.all():
            at, partial, alive, low, high = at[kept], partial[:, kept], alive[:, kept], low[:, kept], high[:, kept]
    return at, alive, low, high


def products(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a.x[i[s : s + CHUNK]], b.x[j[s : s + CHUNK]]) for s in range(0, len(i), CHUNK)] or [np.zeros(0, np.int64)])


def best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k rows of each key, by score descending and id."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.zeros(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    return order[rank < k]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity if there are fewer."""
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -math.inf)


class Found:
    """The best k products of each key so far, and what the next one has to reach."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.key, self.score, self.ids = n, k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.ids, ids)))
        at = best(key, score, ids, self.k)
        self.key, self.score, self.ids = key[at], score[at], ids[at]

    def reach(self) -> np.ndarray:
        out, n = np.full(self.n, -math.inf), np.bincount(self.key, minlength=self.n)
        last = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(last, self.key, self.score)
        out[n >= self.k] = last[n >= self.k]
        return out


def search(a: Side, b: Side, low: np.ndarray, high: np.ndarray, k: int, same: bool, slack: float) -> Found:
    """For each anchor and window (columns of low and high): the best k rows of b with a product in it. same: of the anchor's label, else of others."""
    n, windows = low.shape
    found = Found(n * windows, k)
    for start in range(0, len(b.ids), CHUNK):
        part = b.take(slice(start, start + CHUNK))
        alive = ((a.labels[:, None] == part.labels[None, :]) == same) & (a.ids[:, None] != part.ids[None, :])
        reach = np.maximum(found.reach().reshape(n, windows), low)
        open_ = low <= high
        least = np.where(open_, reach, math.inf).min(1)
        at, alive, lower, upper = bounds(a, part, alive, slack, least, np.where(open_, high, -math.inf).max(1))
        if not len(at):
            continue
        wanted = np.zeros(alive.shape, bool)
        for w in range(windows):
            sure = alive & (lower >= low[:, w, None]) & (upper <= high[:, w, None])
            least = np.maximum(reach[:, w], kth(np.where(sure, lower, -math.inf), k))
            wanted |= alive & (upper >= least[:, None]) & (lower <= high[:, w, None])
        i, j = np.nonzero(wanted)
        j = at[j]
        score = products(a, part, i, j)
        for w in range(windows):
            fits = (score >= low[i, w]) & (score <= high[i, w])
            found.add(i[fits] * windows + w, score[fits], part.ids[j[fits]])
    return found


def without_copies(side: Side, k: int) -> Side:
    """Of equal vectors with one label only the k rows of least id can be among the best k of any anchor but one of themselves: keep one more."""
    whole = np.ascontiguousarray(np.column_stack([side.labels.astype(np.int64), side.x]))
    key = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    return side.take(np.sort(best(key, np.zeros(len(key), np.int64), side.ids, k + 1)))


def side(table: pa.Table, turn: np.ndarray) -> Side:
    return Side(table.column("vec_id").to_numpy(), table.column("label").to_numpy(), matrix(table.column("x"), len(turn)), turn)


def nearest(anchors: pa.Table, rows: pa.Table, turn: np.ndarray, k: int, same: bool) -> pa.Table:
    """One cell of the grid: a block of anchors against a block of rows."""
    names = ["anchor_id", "window", "vec_id", "score"]
    if not anchors.num_rows or not rows.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
    a, b = side(anchors, turn), without_copies(side(rows, turn), k)
    if same:
        low, high = np.full((len(a.ids), 1), LEAST), np.full((len(a.ids), 1), -LEAST)
    else:
        scores = anchors.column("positives").to_pylist()
        windows = max(map(len, scores))
        low, high = np.ones((len(a.ids), windows), np.int64), np.zeros((len(a.ids), windows), np.int64)
        for i, row in enumerate(scores):
            low[i, : len(row)], high[i, : len(row)] = [-(-30 * p // 100) for p in row], [90 * p // 100 for p in row]
    found = search(a, b, low, high, k, same, slack_of(turn))
    return pa.table([pa.array(a.ids[found.key // low.shape[1]]), pa.array((found.key % low.shape[1]).astype(np.int32)), pa.array(found.ids), pa.array(found.score)], names=names)


def grid(anchors: DataFrame, rows: DataFrame, turn: np.ndarray, k: int, same: bool, blocks: tuple[int, int]) -> DataFrame:
    """The best k of each anchor and window over all rows. Every block of anchors meets every block of rows; blocks are of bounded size."""

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(anchors, "anchor_block", blocks[0], "row_block", blocks[1]).groupBy("anchor_block", "row_block")
    right = dealt(rows, "row_block", blocks[1], "anchor_block", blocks[0]).groupBy("anchor_block", "row_block")
    each = left.cogroup(right).applyInArrow(functools.partial(nearest, turn=turn, k=k, same=same), "anchor_id long, window int, vec_id long, score long")
    first = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels that score 30 to 90 hundredths of it.

    vectors: vec_id long, label, x (array of int). Rows without id, label or vector take no part. Rows are told apart by vec_id: an anchor meets no row of its
    own id, and of anchors that share an id the least (label, x) stands for all; other repeated rows count each. Missing components count as zero. Ties
    go by vec_id. No anchors, or no rows of another label, give no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    rows = written(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "x"), "vectors")
    n, size = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("least"))
    anchors = written(anchors.select("vec_id", "least.label", "least.x"), "anchors")
    blocks = (max(1, math.ceil(anchors.count() / BLOCK_ANCHORS)), max(LEAST_BLOCKS, math.ceil(n / BLOCK_ROWS)))
    turn = rotation(rows, max(size or 0, 1))
    best_rows = written(grid(anchors, rows, turn, positives, True, blocks), "positives")
    listed = best_rows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("listed"))
    told = anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("positives", F.col("listed.positive_score")).drop("listed")
    taken = grid(told, rows, turn, negatives, False, blocks)
    pairs = best_rows.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = taken.join(pairs, ["anchor_id", "window"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def embedding_vectors(embeddings: DataFrame, label: Column) -> DataFrame:
    """Rows of embeddings as hard_negatives takes them, with the given label; those with a null or non-finite component are left out."""
    fine = embeddings.where(usable(F.col("embedding"))).select("vec_id", label.alias("label"), "embedding")
    size = fine.agg(F.max(F.size("embedding"))).first()[0] or 1
    return fine.select("vec_id", "label", quantised(F.col("embedding"), size).alias("x"))
