"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are tiled by the population counts of their parts. Two fingerprints differ in at least as many bits as
their parts' counts differ in sum, so only pairs of tiles within the radius are compared; within those, every pair is, as blocks of
exclusive-or and bit counts in numpy. A tile with more than ROWS_PER_TILE fingerprints is cut into several, so no task holds
an unbounded group: a task keeps one tile and streams its visitors past it.

A task returns the links that join its tile's groups, a spanning forest and not all pairs; groups are the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes, written
from .components import connected_components

BITS = 64
RADIUS = 3
WORDS = 3
SEED = 42
PARTS = 4
ROWS_PER_TILE = 4096
BLOCK = 1 << 20
SHINGLES_AT_ONCE = 1 << 16


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; sums of 255 rows at a time still fit a byte."""
    rows = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    rows[: len(hashes)] = hashes
    bits = np.unpackbits(rows.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(data: bytes, words_in: int = WORDS, seed: int = SEED) -> int:
    """SimHash over word shingles of UTF-8 bytes, A-Z lower-cased; 0 without words.

    A bit is set if it is in over half the shingles' XXH64 hashes, repeats included.
    """
    import xxhash

    words = data.lower().split()  # of bytes: ASCII letters, and white space 09-0D and 20
    if not words:
        return 0
    n = max(1, len(words) - words_in + 1)
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        some = words[at : at + SHINGLES_AT_ONCE + words_in - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(words_in)))) if len(words) >= words_in else [b" ".join(words)]
        hashes = np.array([digest(s, seed) for s in shingles], dtype=np.uint64)
        votes += bit_sums(hashes)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words_in: int = WORDS) -> DataFrame:
    """key and fp (the fingerprint as a signed long) of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words_in) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key), text_bytes(F.col(text)))
    return rows.mapInArrow(run, T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())]))


def tile_of(fp: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """The population counts of the parts as one number."""
    width = BITS // parts
    mask = np.uint64((1 << width) - 1)
    tile = np.zeros(len(fp), np.int64)
    for i in range(parts):
        tile = tile * (width + 1) + np.bitwise_count(fp.view(np.uint64) >> np.uint64(i * width) & mask)
    return tile


def neighbours(radius: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Differences of the parts' counts that sum to the radius at most, one of each pair of opposites; first the zero."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius]
    return sorted((d for d in steps if d >= (0,) * parts), key=lambda d: (d != (0,) * parts, d))


def _cut(fp: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which part of its tile a fingerprint is in."""
    mixed = fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % cuts.astype(np.uint64)).astype(np.int64)


def links_within(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """Links a, b between fingerprints of ``distinct`` (a long column fp) so that groups within the radius are joined.

    The counts of tiles come to the driver: (64 / parts + 1) ** parts numbers at most, whatever the input.
    """
    spark: SparkSession = distinct.sparkSession
    width = BITS // parts
    side = width + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side**parts, np.int64)
        for batch in batches:
            total += np.bincount(tile_of(batch.column(0).to_numpy(zero_copy_only=False), parts), minlength=side**parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["tile", "n"])

    counts = np.zeros(side**parts, np.int64)
    for tile, n in distinct.select("fp").mapInArrow(count, "tile bigint, n bigint").groupBy("tile").agg(F.sum("n")).collect():
        counts[tile] = n
    shared = spark.sparkContext.broadcast(-(-counts // rows_per_tile))
    steps, powers = neighbours(radius, parts), side ** np.arange(parts - 1, -1, -1)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint at home in its tile, and as a visitor to tiles within the radius: a pair of tiles meets once."""
        cuts = shared.value
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            home = tile_of(fp, parts)
            digits = home[:, None] // powers % side
            own = _cut(fp, cuts[home])
            for step in steps:
                there = digits + np.array(step)
                rows = np.flatnonzero(((there >= 0) & (there < side)).all(axis=1))
                tile = there[rows] @ powers
                n = cuts[tile]
                rows, tile, n = rows[n > 0], tile[n > 0], n[n > 0]
                which = np.repeat(np.arange(len(rows)), n)
                part = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                rows, tile = rows[which], tile[which]
                if not any(step):  # at home once, and a visitor to the later cuts of its own tile
                    kept = part >= own[rows]
                    rows, tile, part = rows[kept], tile[kept], part[kept]
                    visitor = part > own[rows]
                else:
                    visitor = np.ones(len(rows), bool)
                yield pa.RecordBatch.from_arrays([pa.array(tile << 24 | part), pa.array(visitor), pa.array(fp[rows])], names=["place", "visitor", "fp"])

    dealt = distinct.select("fp").mapInArrow(visits, "place bigint, visitor boolean, fp bigint")
    at_places = dealt.repartition("place").sortWithinPartitions("place", "visitor")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tile = None, Tile(radius)
        for batch in batches:
            place, visitor, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            starts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (visitor[1:] != visitor[:-1]))) if len(place) else []
            for a, b in zip(starts, [*starts[1:], len(place)]):
                if place[a] != here:
                    yield tile.finish()
                    here, tile = place[a], Tile(radius)
                yield from tile.visit(fp[a:b]) if visitor[a] else tile.settle(fp[a:b])
        yield tile.finish()

    return at_places.mapInArrow(compare, "a bigint, b bigint")


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


class Tile:
    """The fingerprints of one place, and which of them are joined so far."""

    def __init__(self, radius: int) -> None:
        self.radius, self.waiting, self.home = radius, [], None

    def settle(self, fp: np.ndarray) -> tuple[()]:
        self.waiting.append(fp.view(np.uint64))
        return ()

    def _near(self, fp: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of fp in blocks, with where they are within the radius of the others."""
        step = max(1, BLOCK // max(1, len(others)))
        for at in range(0, len(fp), step):
            yield at, np.bitwise_count(fp[at : at + step, None] ^ others[None, :]) <= self.radius

    def _open(self) -> None:
        if self.home is None:
            self.home = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint64)
            self.root = np.arange(len(self.home))
            for at, near in self._near(self.home, self.home):
                i, j = np.nonzero(near)
                self._join(i + at, j)

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join pairs of homes: hook the larger root to the smaller, then point all at their roots."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up

    def visit(self, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of visitors to the first home near them; other homes near them are joined with that."""
        self._open()
        fp = fp.view(np.uint64)
        for at, near in self._near(fp, self.home) if len(self.home) else ():
            if len(rows := np.flatnonzero(near.any(axis=1))):
                near = near[rows]
                first = near.argmax(axis=1)
                v, j = np.nonzero(near)
                self._join(first[v], j)
                yield _links(fp[at + rows], self.home[first])

    def finish(self) -> pa.RecordBatch:
        self._open()
        joined = np.flatnonzero(self.root != np.arange(len(self.root)))
        return _links(self.home[joined], self.home[self.root[joined]])


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, words_in: int = WORDS) -> DataFrame:
    """key, fp and component_id (the smallest key that links reach, itself included) of each row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null key have a component
    but don't name it, unless no row in it has a key: then component_id is null. Repeated rows repeat. Empty input gives an empty result.
    """
    fps = written(fingerprints(docs, text, key, words_in), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    members = connected_components(links_within(distinct, radius))
    named = members.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("first").alias("least"))
    linked = members.join(named, "component").select("node", "least")
    of_fp = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "first").alias("component_id"))
    of_fp = written(of_fp, "of-fingerprint")  # so that both sides of the last join are dealt anew and a hot fingerprint can be split
    return fps.join(of_fp, F.col("fp") == F.col("_fp")).select(F.col("key").alias(key), "fp", "component_id")
