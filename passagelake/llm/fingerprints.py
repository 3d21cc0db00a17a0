"""Document fingerprints: SimHash over weighted terms, and a search within a Hamming radius.

Terms are words and pairs of neighbouring words, each weighted by 1 + ln(its count in the text). A term's hash votes with its weight for each
bit it has set and against each other. Fingerprints have 128 bits, kept as 32 hex digits.

The search keeps one table for each block of bits, as if the bits were permuted to bring that block to the front: fingerprints that
differ in fewer bits than there are blocks agree in a block, so equal blocks find all of them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 128
TERMS_AT_ONCE = 4096
MOST_CACHED = 500_000
BYTES_PER_PARTITION = 128 << 20
#: Of the searches in the query, and the parts that each block value is cut into, as a common one may be in many fingerprints.
RADIUS, SALTS = 3, 8
#: Odd multipliers that mix 64-bit numbers (fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@functools.cache
def _known() -> dict[bytes, int]:
    """Hashes of words, kept for each Python worker."""
    return {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    known = _known()
    if new := set(words).difference(known):
        if len(known) > MOST_CACHED:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_intdigest(w, 7)) for w in new)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MIX[by]
    return h ^ h >> np.uint64(29)


def fingerprint(text: str) -> np.ndarray:
    """The two 64-bit halves of a text's fingerprint; zeros without words."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(2, np.uint64)
    h = _word_hashes(words)
    pairs = _mixed(h[:-1], 2) + h[1:]
    terms, counts = np.unique(np.concatenate((h, pairs)), return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    both = np.stack((_mixed(terms, 0), _mixed(terms, 1)), axis=1)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), TERMS_AT_ONCE):
        bits = np.unpackbits(both[at : at + TERMS_AT_ONCE].view(np.uint8), axis=1, bitorder="little")
        votes += weights[at : at + TERMS_AT_ONCE] @ bits.astype(np.float32)
    return np.packbits(votes > weights.sum(dtype=np.float64) / 2, bitorder="little").view(np.uint64)


def digits(fp: np.ndarray) -> str:
    return f"{int(fp[1]):016x}{int(fp[0]):016x}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fingerprint of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digits(fingerprint(x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "fingerprint"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("fingerprint", T.StringType())]))


def beside_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and text, cut into partitions by descending key and sorted there, each closed by the rows that the next one begins with (tail is true).

    Cuts are keys of the table, one a partition: a row whose key is a cut is the first of its partition and so is sent once more to the
    partition before, whose last row it follows. The row with the largest key follows the last of all.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_PARTITION))
    shares = [(i + 1) / parts for i in range(parts)]
    found = rows.agg(F.percentile_approx("key", shares, 100 * parts).alias("cuts"), F.max("key").alias("last")).first()
    cuts = np.unique(np.array([*(found["cuts"] or []), *([] if found["last"] is None else [found["last"]])], dtype=np.int64))

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        at = np.minimum(np.searchsorted(cuts, k), max(len(cuts) - 1, 0))
        on = cuts[at] == k if len(cuts) else np.zeros(len(k), bool)
        return pd.Series([[a, -1 - (a + 1) % len(cuts)] if o else [a] for a, o in zip(at.tolist(), on.tolist())])

    # A place below 0 is that of a tail. Null keys come last of all, in the partition of the smallest keys.
    dealt = rows.select("key", "text", F.explode(F.when(F.col("key").isNull(), F.array(F.lit(0))).otherwise(places(F.coalesce("key", F.lit(0))))).alias("place"))
    dealt = dealt.select("key", "text", (F.col("place") < 0).alias("tail"), F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("place"))
    placed = dealt.repartitionById(max(len(cuts), 1), F.col("place").cast("int"))
    return placed.sortWithinPartitions("tail", F.desc_nulls_last("key"), "text").select("key", "text", "tail")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_likeness(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and how like they are to each other and to the next document's.

    The next document is that of the next smaller key; equal keys follow in the order of their texts, null keys come last, and
    the last row's next is the first. Null texts count as empty. A single row is its own next. Empty input gives an empty result.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, words, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if tail and before is None:  # the first tail was enough, or there is nothing to follow
                    continue
                words = words.as_py()
                own = fingerprint(words)
                if before is not None:
                    old_key, old, old_fp = before
                    new = edited(old, words)
                    new_fp = fingerprint(new)
                    row = (old_key, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), digits(old_fp), digits(new_fp), likeness(old_fp, new_fp), likeness(old_fp, own))
                    for column, x in zip(out, row):
                        column.append(x)
                before = None if tail else (k, words, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    schema = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs, text, key).mapInArrow(run, schema)


def _halves(fp: str) -> list:
    return [F.conv(F.substring(fp, at, 8), 16, 10).cast("long").alias(f"w{i}") for i, at in enumerate((1, 9, 17, 25))]


def _block(fp: str, i: int, blocks: int) -> Column:
    width = BITS // 4 // blocks
    return F.substring(fp, i * width + 1, width if i + 1 < blocks else BITS)


def block_tables(prints: DataFrame, blocks: int, fingerprint_column: str = "fingerprint") -> DataFrame:
    """Each distinct fingerprint once for each block: fp, block, its bits (as hex digits)."""
    distinct = prints.select(F.col(fingerprint_column).alias("fp")).where(F.col("fp").isNotNull()).distinct()
    cut = F.array(*(F.struct(F.lit(i).alias("block"), _block("fp", i, blocks).alias("bits")) for i in range(blocks)))
    return distinct.select("fp", F.explode(cut).alias("cut")).select("fp", "cut.block", "cut.bits")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """query_fp, fp and distance of all pairs of a fingerprint of ``queries`` and a distinct one of ``prints`` that differ in ``radius`` bits (31 at most) or fewer.

    Exact: more blocks than radius, at least one of which is free of differences. A value of a block is cut into SALTS parts by fingerprint, to each of which its queries go, so
    that a common one isn't one task's. A pair with several equal blocks is returned in the first. Nulls match nothing; empty tables give an empty result.
    """
    if not 0 <= radius < 32:
        raise ValueError("the radius must be 0 to 31")
    blocks = next(b for b in (1, 2, 4, 8, 16, 32) if b > radius)
    tables = block_tables(prints, blocks).withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    asked = block_tables(queries, blocks).select("block", "bits", F.col("fp").alias("query_fp"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = asked.join(tables, ["block", "bits", "salt"])
    first = F.coalesce(*(F.when(_block("fp", i, blocks) == _block("query_fp", i, blocks), i) for i in range(blocks)))
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_halves("fp"), _halves("query_fp"))), F.lit(0))
    return pairs.where(F.col("block") == first).select("query_fp", "fp", distance.cast("int").alias("distance")).where(F.col("distance") <= radius)


def count_within_radius(prints: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """Add within_radius: for rows where ``asked`` holds, how many distinct fingerprints other than their own are within the radius; null for other rows.

    prints must be a table, as it is read three times. A null fingerprint has none. Equal rows get equal counts.
    """
    prints = prints.drop("within_radius")
    found = within_radius(prints.where(asked), prints, radius).groupBy("query_fp").agg((F.count("*") - 1).alias("_near"))
    rows = prints.where(asked).join(found, F.col("fingerprint") == F.col("query_fp"), "left").select(*prints.columns, F.coalesce("_near", F.lit(0)).alias("within_radius"))
    return rows.unionByName(prints.where(~F.coalesce(asked, F.lit(False))).withColumn("within_radius", F.lit(None).cast("long")))
