"""Near-duplicates by Jaccard similarity of shingle sets: SimHash finds candidates, the whole sets decide.

A fingerprint of 2048 bits over the set of a text's word shingles tells the similarity of two sets: radii hold all pairs of the wanted
one but one in a million, also for sets so small that tied votes matter. At this similarity a pair may differ in a fifth of its bits, while
population counts spread by a hundredth, so tiles by population counts alone would all have to meet, and work would grow with the
square of the texts. Tiles are therefore formed by shared keys: each of BANDS keys is made of the least values of the set under LEAST_OF
hash functions, so unrelated sets don't meet whatever their number, and a pair of the similarity meets in none with a chance of one in a million.
Copies of a text's row are BANDS at any size of the input. Only keys that several sets have become tiles; in those, rows are compared by exclusive-or and bit count in
numpy blocks, first 128 bits, then 512, then all; blocks whose set sizes or population counts differ beyond the reach are skipped.

A tile with more than ROWS_PER_TILE rows is cut. There are two passes. The first joins rows of a cut by the similarity told, each row once;
its links are held against the whole shingle sets and joined to groups. The second takes only rows that have a candidate, in tiles with rows of different
groups, with finer fingerprints of 8192 bits, and returns every candidate between different groups: in a cut tile, rows of its largest
group stay at home and only the others visit all cuts, so copies in great numbers cost no more than their number. A pair
is left unchecked only if checked links join it already.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes, written
from .components import connected_components

#: 64-bit lanes of fingerprints: for all sets, and for those that have a candidate.
LANES, FINE = 32, 128
WORDS = 5
SEED = 42
SIMILARITY = 0.8
#: Chance that a pair of the wanted similarity is beyond a radius (4.75 spreads or so).
MISSED = 1e-6
#: What the first pass wants above the similarity, and the bands whose tiles it takes links from. They only spare the second work.
ABOVE, LINKING = 0.02, 4
#: Lanes in each comparison, the last of all.
STEPS, FINE_STEPS = (2, 8, LANES), (2, 8, LANES, FINE)
#: From this size of sets on, ties of votes matter little.
LARGE = 64
#: Keys of a set, and least values in each: 0.8 ** 3 = 0.512 of pairs at 0.8 share a key, all but 0.488 ** 19 one of them.
BANDS, LEAST_OF = 19, 3
ROWS_PER_TILE = 4096
#: Tiles up to this size are compared many at a time.
SMALL = 16
BLOCK, PAIRS_AT_ONCE = 1 << 20, 1 << 14
SHINGLES_AT_ONCE = 510
#: Odd multipliers, one for each 64 bits and for each least value, and the mixing steps' constant (made from a rule).
MULTIPLIERS = (np.arange(1, FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
LEAST_BY = np.random.default_rng(SEED).integers(0, 2**64, BANDS * LEAST_OF, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(data: bytes, words_in: int = WORDS) -> np.ndarray:
    """Sorted hashes of the set of word shingles (A-Z lower-cased); a text of fewer words is one shingle."""
    import xxhash

    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in)))) if len(words) >= words_in else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64))


def _mixed(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    mixed = hashes[:, None] * by
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX
    return mixed


def long_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> bytes:
    """The fingerprint of a shingle set; zeros without words. One of fewer lanes is the start of one of more."""
    votes = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = hashes[at : at + SHINGLES_AT_ONCE]
        rows = np.zeros((-(-len(some) // 255) * 255, lanes), np.uint64)  # sums of 255 rows still fit a byte
        mixed = _mixed(some, MULTIPLIERS[:lanes])
        rows[: len(some)] = mixed ^ mixed >> np.uint64(32)
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
        votes += bits.reshape(-1, 255, 64 * lanes).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a shingle set: sets of Jaccard similarity s have equal keys with a chance of s ** LEAST_OF each."""
    least = np.full(BANDS * LEAST_OF, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        np.minimum(least, _mixed(hashes[at : at + SHINGLES_AT_ONCE], LEAST_BY).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for values in least.reshape(BANDS, LEAST_OF).T:
        keys = (keys ^ values) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def short_keys(hashes: np.ndarray) -> bytes:
    """The lower half of each of the keys."""
    return band_keys(hashes).astype(np.uint32).tobytes()


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key, hash of the text, and the text's bytes: key and hash tell different rows apart."""
    data = text_bytes(F.col(text))
    return docs.select(F.col(key).alias("key"), F.xxhash64(data).alias("hash"), data.alias("data"))


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id", words_in: int = WORDS) -> DataFrame:
    """key, hash (of the text), and digest, n, fp and bands of the shingle set of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            digests, sizes, fps, bands = [], [], [], []
            for x in batch.column(2):
                hashes = shingle_set(x.as_py(), words_in)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                fps.append(long_fingerprint(hashes))
                bands.append(band_keys(hashes))
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "hash", "digest", "n", "fp", "bands"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)])
    for name, kind in (("hash", T.LongType()), ("digest", T.BinaryType()), ("n", T.LongType()), ("fp", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))):
        schema.add(name, kind)
    return _keyed(docs, text, key).mapInArrow(run, schema)


def _differing(common: int, only_a: int, only_b: int) -> float:
    """The chance that a bit differs between two sets: each shingle votes +1 or -1, and a tie gives 0."""
    put = lambda n: np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n
    total = 2 * np.arange(common + 1) - common

    def set_by(n: int) -> np.ndarray:
        return (put(n)[None] * (total[:, None] + 2 * np.arange(n + 1)[None] - n > 0)).sum(axis=1)

    a, b = set_by(only_a), set_by(only_b)
    return float((put(common) * (a * (1 - b) + b * (1 - a))).sum())


def _radius(bits: int, share: float) -> int:
    """The least number that more differing bits than that have a chance of MISSED at most."""
    logs = [math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(share) + (bits - k) * math.log1p(-share) for k in range(bits + 1)]
    beyond = np.cumsum(np.exp(logs)[::-1])[::-1]
    return int(np.flatnonzero(np.append(beyond[1:], 0) <= MISSED)[0])


@functools.cache
def radii(least: float, steps: tuple[int, ...] = STEPS) -> np.ndarray:
    """For each size of the smaller set, or LARGE and more, the radius of each step that holds pairs of at least that similarity."""
    share = np.full(LARGE + 1, 1e-9)
    share[LARGE] = math.acos(min(1.0, 2 * least / (1 + least))) / math.pi + 1e-9
    for n in range(1, LARGE + 1):
        for m in range(n, math.floor(n / least + 1e-9) + 1):
            for common in range(math.ceil(least * (n + m) / (1 + least) - 1e-9), n + 1):
                share[n] = max(share[n], _differing(common, n - common, m - common))
    share[LARGE] = share[-16:].max()  # sizes of every parity
    share = np.maximum.accumulate(share[::-1])[::-1]
    return np.array([[_radius(64 * lanes, p) for lanes in steps] for p in share.tolist()])


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that fingerprints (rows of 64-bit words) and sizes of the sets tell."""
    differing = np.bitwise_count(a ^ b).sum(axis=1)
    both = np.cos(np.pi * differing / (64 * a.shape[1])) * np.sqrt(n_a.astype(np.float64) * n_b)
    return both / np.maximum(n_a + n_b - both, 1e-9)


class Rows:
    """Rows of distinct sets as columns: ids, n, group, fp (64-bit words), and keys (32 bits of each band's, or none)."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, group: np.ndarray, fp: np.ndarray, keys: np.ndarray) -> None:
        self.ids, self.n, self.group, self.fp, self.keys = ids, n, group, fp, keys

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        ids, n, group = (batch.column(name).to_numpy() for name in ("id", "n", "group"))
        fp, keys = (np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.uint32) for name in ("fp", "keys"))
        return cls(ids, n, group, fp.view(np.uint64).reshape(len(batch), -1), keys.reshape(len(batch), -1) if len(keys) else np.empty((len(batch), 0), np.uint32))

    def take(self, rows: np.ndarray | slice) -> Rows:
        return Rows(self.ids[rows], self.n[rows], self.group[rows], self.fp[rows], self.keys[rows])

    @classmethod
    def together(cls, parts: list[Rows]) -> Rows:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "n", "group", "fp", "keys")))


class Comparison:
    """What is compared, and what is returned: with ``told``, links that join rows told so similar; without it, all candidates between groups."""

    def __init__(self, least: float, told: float | None, steps: tuple[int, ...]) -> None:
        self.least, self.told, self.steps, self.within = least, told, steps, radii(least, steps)

    def closer(self, a: Rows, i: np.ndarray, b: Rows, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of rows, those of different groups within every radius, and the similarity told."""
        small, big = np.minimum(a.n[i], b.n[j]), np.maximum(a.n[i], b.n[j])
        fits = (small >= big * self.least - 1e-6) & (a.group[i] != b.group[j])
        i, j, small = i[fits], j[fits], np.minimum(small[fits], LARGE)
        for step, lanes in enumerate(self.steps):
            close = np.bitwise_count(a.fp[i, :lanes] ^ b.fp[j, :lanes]).sum(axis=1) <= self.within[small, step]
            i, j, small = i[close], j[close], small[close]
        return i, j, similarity(a.fp[i], b.fp[j], a.n[i], b.n[j])

    def first(self, a: Rows, i: np.ndarray, b: Rows, j: np.ndarray, band: np.ndarray | int) -> pa.RecordBatch:
        """Links of the pairs that share no key of a band before this one, so that each is returned once."""
        here = (a.keys[i] == b.keys[j]).argmax(axis=1) == band
        return _links(a.ids[i[here]], b.ids[j[here]])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def compare_small(how: Comparison, bucket: np.ndarray, band: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
    """Links in whole small tiles, sorted by bucket and id. Joining links are stars: a row and the first that it seems similar to. Rows that have a candidate are linked with themselves."""
    found = []
    for d in range(1, SMALL):
        i = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(i):
            break
        for at in range(0, len(i), PAIRS_AT_ONCE):
            some = i[at : at + PAIRS_AT_ONCE]
            found.append(how.closer(rows, some, rows, some + d))
    if not found:
        return
    i, j, told = (np.concatenate(x) for x in zip(*found))
    if how.told is None:
        yield how.first(rows, i, rows, j, band[i])
    else:
        met = np.unique(np.concatenate((i, j)))
        yield _links(rows.ids[met], rows.ids[met])
        seem = np.flatnonzero((told >= how.told) & (band[i] < LINKING))
        seem = seem[np.lexsort((i[seem], j[seem]))]
        _, first = np.unique(j[seem], return_index=True)
        yield _links(rows.ids[i[seem[first]]], rows.ids[j[seem[first]]])


class Tile:
    """A large tile, or a cut of one: rows at home, by size of their sets, to which visitors come."""

    def __init__(self, how: Comparison, band: int) -> None:
        self.how, self.band, self.waiting, self.home = how, band, [], None

    def settle(self, rows: Rows) -> None:
        self.waiting.append(rows)

    def open(self) -> Iterator[pa.RecordBatch]:
        """Takes what waits as the rows at home; links among them."""
        if self.home is None and self.waiting:
            home = Rows.together(self.waiting)
            self.home, self.waiting = home.take(np.argsort(home.n, kind="stable")), []
            self.lead = [np.ascontiguousarray(self.home.fp[:, k]) for k in range(self.how.steps[0])]
            self.bits = np.bitwise_count(self.home.fp).sum(axis=1, dtype=np.int64)
            self.root = np.arange(len(self.home.ids))
            met = np.zeros(len(self.root), bool)
            for i, j, told in self.near(self.home, self.bits, later=True):
                if self.how.told is None:
                    yield self.how.first(self.home, i, self.home, j, self.band)
                    continue
                met[i] = met[j] = True
                if self.band < LINKING:
                    seem = np.flatnonzero(told >= self.how.told)
                    seem = seem[np.argsort(-told[seem], kind="stable")]
                    yield from self.join(i[seem], j[seem])
            yield _links(self.home.ids[met], self.home.ids[met])

    def near(self, rows: Rows, bits: np.ndarray, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates: one of the rows given (by size), a row at home, and the similarity told; with later, only of those at home after it."""
        n, least, within = self.home.n, self.how.least, self.how.within
        step = max(1, BLOCK // max(1, len(n)))
        for at in range(0, len(rows.n), step):
            end = min(at + step, len(rows.n))
            start = max(at if later else 0, int(np.searchsorted(n, rows.n[at] * least - 1e-6)))
            stop = int(np.searchsorted(n, rows.n[end - 1] / least + 1e-6, side="right"))
            if start >= stop:
                continue
            radius = within[min(LARGE, rows.n[at], n[start])]
            here, there = bits[at:end], self.bits[start:stop]
            if max(int(here.min()) - int(there.max()), int(there.min()) - int(here.max())) > radius[-1]:
                continue
            differing = sum(np.bitwise_count(rows.fp[at:end, k, None] ^ lead[None, start:stop]) for k, lead in enumerate(self.lead))
            i, j = np.nonzero(differing <= radius[0])
            i, j = i + at, j + start
            if later:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), PAIRS_AT_ONCE):
                found = self.how.closer(rows, i[part : part + PAIRS_AT_ONCE], self.home, j[part : part + PAIRS_AT_ONCE])
                if len(found[0]):
                    yield found

    def join(self, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Joins rows and returns one link, the first given, for each group that is joined to another."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            joined, first = np.unique(np.maximum(a, b), return_index=True)
            self.root[joined] = np.minimum(a, b)[first]
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up
            yield _links(self.home.ids[i[first]], self.home.ids[j[first]])

    def visit(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        """All candidates between visitors and rows at home of other groups."""
        yield from self.open()
        if self.home is not None:
            rows = rows.take(np.argsort(rows.n, kind="stable"))
            for i, j, _ in self.near(rows, np.bitwise_count(rows.fp).sum(axis=1, dtype=np.int64)):
                yield self.how.first(rows, i, self.home, j, self.band)


def compare(batches: Iterator[pa.RecordBatch], how: Comparison) -> Iterator[pa.RecordBatch]:
    """Links of rows dealt by bucket and cut, and sorted by those, visitors last, and id."""
    here, tile, held = None, None, None
    for batch in batches:
        size = batch.column("rows").to_numpy()
        for some in (batch.filter(pa.array(size <= SMALL)), batch.filter(pa.array(size > SMALL))):
            if not len(some):
                continue
            bucket, size, band = (some.column(name).to_numpy() for name in ("bucket", "rows", "band"))
            rows = Rows.of(some)
            if size[0] <= SMALL:
                if held:
                    bucket, size, band, rows = np.append(held[0], bucket), np.append(held[1], size), np.append(held[2], band), Rows.together([held[3], rows])
                last = int(np.searchsorted(bucket, bucket[-1])) if np.all(bucket[1:] >= bucket[:-1]) else int(np.flatnonzero(bucket != bucket[-1]).max(initial=-1)) + 1
                whole = len(bucket) if len(bucket) - last == size[-1] else last
                held = (bucket[whole:], size[whole:], band[whole:], rows.take(slice(whole, None))) if whole < len(bucket) else None
                if whole:
                    yield from compare_small(how, bucket[:whole], band[:whole], rows.take(slice(whole)))
                continue
            cut, visitor = some.column("cut").to_numpy(), some.column("visitor").to_numpy(zero_copy_only=False)
            changes = (bucket[1:] != bucket[:-1]) | (cut[1:] != cut[:-1]) | (visitor[1:] != visitor[:-1])
            starts = np.append(0, np.flatnonzero(changes) + 1)
            for a, b in zip(starts, np.append(starts[1:], len(bucket))):
                if (place := (bucket[a], cut[a])) != here:
                    if tile:
                        yield from tile.open()
                    here, tile = place, Tile(how, int(band[a]))
                if visitor[a]:
                    yield from tile.visit(rows.take(slice(a, b)))
                else:
                    tile.settle(rows.take(slice(a, b)))
    if held:
        yield from compare_small(how, held[0], held[2], held[3])
    if tile:
        yield from tile.open()


def tile_rows(distinct: DataFrame) -> DataFrame:
    """bucket, band, rows (of the bucket), id, n of each row of ``distinct`` (id, n, bands) whose bucket others share."""
    at = distinct.select("id", "n", F.posexplode("bands").alias("band", "bucket")).withColumn("band", F.col("band").cast("byte"))
    shared = at.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    return at.join(shared, "bucket")


def similar_links(rows: DataFrame, least: float = SIMILARITY, above: float = ABOVE, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """Links a, b that join ``rows`` (of tiles, with fp) told so much above the similarity, and links of a row with itself for all that have a candidate; may repeat."""
    how = Comparison(least, least + above, STEPS)
    return _compared(rows.withColumns({"group": F.col("id"), "keys": F.lit(b"")}).select(*AT_HOME, _cut(rows_per_tile).alias("cut"), F.lit(False).alias("visitor")), how)


def candidates(rows: DataFrame, least: float = SIMILARITY, rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """All candidate links a, b between different groups of ``rows`` (of tiles, with group, fine fingerprints as fp, and keys: 4 bytes of each band's); few repeat."""
    how = Comparison(least, None, FINE_STEPS)
    home = rows.select(*AT_HOME, _cut(rows_per_tile).alias("cut"), F.lit(False).alias("visitor"))
    large = rows.where(_cuts(rows_per_tile) > 1)
    largest = large.groupBy("bucket", "group").agg(F.count("*").alias("of_it")).groupBy("bucket").agg(F.max_by("group", F.struct("of_it", "group")).alias("largest"))
    others = large.join(largest, "bucket").where(F.col("group") != F.col("largest"))
    visits = others.select(*AT_HOME, F.explode(F.sequence(F.lit(0), _cuts(rows_per_tile) - 1)).alias("cut"), F.lit(True).alias("visitor"))
    return _compared(home.unionByName(visits), how)


AT_HOME = ("bucket", "band", "rows", "id", "n", "fp", "group", "keys")


def _cuts(rows_per_tile: int) -> Column:
    return F.ceil(F.col("rows") / rows_per_tile).cast("int")


def _cut(rows_per_tile: int) -> Column:
    return F.pmod(F.xxhash64("id", "bucket"), _cuts(rows_per_tile)).cast("int")


def _compared(dealt: DataFrame, how: Comparison) -> DataFrame:
    placed = dealt.repartition("bucket", "cut").sortWithinPartitions("bucket", "cut", "visitor", "id")
    return placed.mapInArrow(lambda batches: compare(batches, how), "a bigint, b bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, words_in: int) -> DataFrame:
    """id, hashes of the shingle set, its fine fingerprint and short keys, of the whole texts of the rows ``wanted`` (id, row: nokey, key and hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # one by one: sets of long texts are large
                hashes = shingle_set(batch.column(1)[at].as_py(), words_in)
                columns = [batch.column(0).slice(at, 1), pa.array([hashes.view(np.int64)], pa.list_(pa.int64())), pa.array([long_fingerprint(hashes, FINE)], pa.binary()), pa.array([short_keys(hashes)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "hashes", "fine", "keys"])

    asked = wanted.select("id", *_place(F.col("row.key"), F.col("row.hash")))
    texts = _keyed(docs, text, key).select(*_place(F.col("key"), F.col("hash")), "data")
    found = texts.join(asked, ["_nokey", "_key", "_hash"]).select("id", "data")
    return found.dropDuplicates(["id"]).mapInArrow(run, "id long, hashes array<bigint>, fine binary, keys binary")


def _place(key: Column, hashed: Column) -> tuple[Column, Column, Column]:
    """Columns that tell different rows apart, none of them null."""
    return key.isNull().alias("_nokey"), F.coalesce(key.cast("string"), F.lit("")).alias("_key"), hashed.alias("_hash")


def checked_links(links: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The links a, b whose whole shingle sets (id, hashes) have at least that Jaccard similarity."""
    left = links.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("of_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))  # row by row: batches of large sets would outgrow memory
    return both.where((common >= 1) & (common / (F.size("of_a") + F.size("of_b") - common) >= least)).select("a", "b")


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, words_in: int = WORDS, rows_per_tile: int = ROWS_PER_TILE) -> tuple[DataFrame, DataFrame]:
    """Two tables: distinct shingle sets (id, digest, row: the first row that has it, as nokey, key and hash; n), and the sets that others are similar to
    with the smallest id that links reach (node, component).

    Null and empty texts are one set; equal texts share theirs. Keys may repeat and be null: sets, not keys, are linked. Empty input gives empty tables.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    found = written(sketches(docs, text, key, words_in), "sketches")
    first = F.min(F.struct(F.col("key").isNull().alias("nokey"), "key", "hash"))
    whole = found.groupBy("digest").agg(first.alias("row"), *(F.first(c).alias(c) for c in ("n", "fp", "bands")))
    distinct = written(whole.withColumn("id", F.monotonically_increasing_id()), "distinct")
    rows = written(tile_rows(distinct), "tile-rows")

    links = written(similar_links(rows.join(distinct.select("id", "fp"), "id"), least, rows_per_tile=rows_per_tile).distinct(), "candidates")
    # Rows of a cut tile met only a part of it.
    met = links.where(F.col("a") == F.col("b")).select(F.col("a").alias("id")).union(rows.where(F.col("rows") > rows_per_tile).select("id")).distinct()
    sets = written(shingle_sets(docs, distinct.join(met, "id", "left_semi"), text, key, words_in), "shingle-sets")
    seen = connected_components(checked_links(links.where(F.col("a") != F.col("b")), sets, least))

    named = seen.select(F.col("node").alias("id"), F.col("component").alias("group"))
    grouped = written(rows.join(sets.select("id"), "id").join(named, "id", "left").withColumn("group", F.coalesce("group", "id")), "grouped")
    mixed = grouped.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("group").alias("low"), F.max("group").alias("high")).where(F.col("low") < F.col("high"))
    left = grouped.drop("rows").join(mixed.select("bucket", "rows"), "bucket").join(sets.select("id", F.col("fine").alias("fp"), "keys"), "id")
    more = candidates(left, least, rows_per_tile).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = checked_links(written(more, "candidates"), sets, least)
    return distinct, connected_components(links.unionByName(seen.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY, words_in: int = WORDS) -> DataFrame:
    """The row with the smallest key of each group of texts that are equal or of that Jaccard similarity, directly or through others.

    Null keys come last. Of several texts of a group that share its smallest key, that with the smallest xxHash64 stays; of rows that share both, the least
    by their columns in order (which must be of types that can be ordered). Different texts that share a key are different rows. Null and
    empty texts are one group. Further columns are kept, whatever their names. Empty input gives an empty result.
    """
    distinct, members = similar_groups(docs, text, key, least, words_in)
    grouped = distinct.select("id", "row").join(members, F.col("id") == F.col("node"), "left")
    best = grouped.groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("row").alias("row"))
    rows = docs.groupBy(*_place(F.col(key), F.xxhash64(text_bytes(F.col(text))))).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return rows.join(best.select(*_place(F.col("row.key"), F.col("row.hash"))), ["_nokey", "_key", "_hash"]).select("_row.*")
