"""The prefix trie of conversations: prefix fingerprints by numpy scans, exact groups, and sums rolled up to parents.

A turn counts by a number t drawn from its role and text, the first d turns by sum of t_i * BASE^i modulo 2^61-1. Such sums are additive, so tasks scan
their own rows only: what stands before a task's first row of a conversation is added later, and a conversation may lie over many tasks.

Rows that share depth and fingerprint are a group. Grouping by role, text and the fingerprint before compares each turn with the representative's (the
smallest member's); where a group holds more than one such variant, it is split, and the groups below it are looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PRIME = (1 << 61) - 1
BASE = 0x1B873593_CC9E2D51 % PRIME
#: A conversation takes fewer than HEADS turns from the first of its hundred.
HEADS, HUNDRED = 6, 100
#: Ids of one row of a node's ends.
ENDS = 8192
SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a*b modulo PRIME for numbers below it, by halves of 32 bits."""
    a, b = np.asarray(a, np.uint64), np.asarray(b, np.uint64)
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid, least = ah * bl + al * bh, al * bl
    total = (ah * bh << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half) + (least & np.uint64(PRIME)) + (least >> np.uint64(61))
    return reduced(total)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def power(exponents: np.ndarray, base: int = BASE) -> np.ndarray:
    """base**exponents modulo PRIME, by squaring."""
    left, out, square = np.asarray(exponents, np.uint64).copy(), np.ones(len(exponents), np.uint64), base
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = times(out[odd], np.uint64(square))
        left >>= np.uint64(1)
        square = square * square % PRIME
    return out


def scan(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums modulo PRIME of the values from the row ``first`` (its index) to each row."""
    low, high = (np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)))
    rows = np.arange(len(values)) + 1
    return reduced(times(reduced(high[rows] - high[first]), np.uint64(1 << 32)) + reduced(low[rows] - low[first]))


def symbols(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each row, the first row of its run of equal keys."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _scan_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation in this task, and sum t * BASE^i over them."""
    task, last, count, total = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, t = batch.column("conv_id").to_numpy(), symbols(batch, "t")
        first = _starts(keys)
        carried = np.uint64(0) + (first == 0) * np.uint64(1) if keys[0] == last else np.zeros(len(keys), np.uint64)
        i = np.arange(len(keys)) - first + carried.astype(np.int64) * count
        sums = reduced(scan(times(t, power(i)), first) + carried * np.uint64(total))
        last, count, total = keys[-1], int(i[-1]) + 1, int(sums[-1])
        more = {"task": np.full(len(keys), task, np.int32), "i": i, "sum": sums.view(np.int64)}
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more.values())], names=[*batch.schema.names, *more])


def _scan_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the parts of conversations in order: how many rows, and which sum, stand before each."""
    last, count, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n, sums = batch.column("conv_id").to_numpy(), batch.column("n").to_numpy(), symbols(batch, "sum")
        first = _starts(keys)
        carried = (first == 0).astype(np.uint64) if keys[0] == last else np.zeros(len(keys), np.uint64)
        through = np.concatenate([[0], np.cumsum(n)])
        before = through[:-1] - through[first] + carried.astype(np.int64) * count
        shifted = times(sums, power(before))
        upto = reduced(scan(shifted, first) + carried * np.uint64(total))
        carry = reduced(upto + np.uint64(PRIME) - shifted)
        last, count, total = keys[-1], int(before[-1] + n[-1]), int(upto[-1])
        yield pa.RecordBatch.from_arrays([batch.column("task"), batch.column("conv_id"), batch.column("n"), pa.array(before), pa.array(carry.view(np.int64))], names=["task", "conv_id", "n", "before", "carry"])


@F.pandas_udf(T.LongType())
def _shifted_sum(carry: pd.Series, before: pd.Series, local: pd.Series) -> pd.Series:
    """A conversation's sum to a row: what stands before its part, and the part's own sum moved behind it."""
    return pd.Series(_whole(carry, before, local).view(np.int64))


def _whole(carry: pd.Series, before: pd.Series, local: pd.Series) -> np.ndarray:
    u = [x.to_numpy(np.int64).view(np.uint64) for x in (carry, local)]
    return reduced(u[0] + times(u[1], power(before.to_numpy(np.int64))))


@F.pandas_udf(T.StructType().add("fp", T.LongType()).add("prev", T.LongType()))
def _rebuilt_sum(carry: pd.Series, before: pd.Series, local: pd.Series, cut: pd.Series, moved: pd.Series, head: pd.Series, t: pd.Series, depth: pd.Series) -> pd.DataFrame:
    """Fingerprints with and without the last turn: the head's sum, then the own one without its first turns, moved up."""
    u = [x.to_numpy(np.int64).view(np.uint64) for x in (cut, head, t)]
    own = reduced(_whole(carry, before, local) + np.uint64(PRIME) - u[0])
    fp = reduced(u[1] + times(own, power(moved.to_numpy(np.int64), pow(BASE, -1, PRIME))))
    prev = reduced(fp + np.uint64(PRIME) - times(u[2], power(depth.to_numpy(np.int64) - 1)))
    return pd.DataFrame({"fp": fp.view(np.int64), "prev": prev.view(np.int64)})


def heads_of(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def scanned_turns(conversations: DataFrame, symbol_bits: int) -> tuple[DataFrame, DataFrame]:
    """Turns with their place and sum within a task's part of a conversation, and the parts with what stands before them."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = ["conv_id", "turn", "tie", "row"]
    t = F.xxhash64("role", "text").bitwiseAND((1 << symbol_bits) - 1)
    told = turns.select("*", F.md5(F.concat_ws("\0", "role", "text").cast("binary")).alias("tie"), F.monotonically_increasing_id().alias("row"), t.alias("t"))
    scanned = told.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "role", "text")
    scanned = written(scanned.mapInArrow(_scan_turns, "conv_id long, t long, role string, text string, task int, i long, sum long"), "turns")
    parts = scanned.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.max_by("sum", "i").alias("sum"))
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "task")
    return scanned, written(parts.mapInArrow(_scan_parts, "task int, conv_id long, n long, before long, carry long"), "parts")


def rebuilt_turns(conversations: DataFrame, symbol_bits: int = 60) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, depth, fp, prev, role, text, is_end), and a row for each conversation with its length."""
    scanned, parts = scanned_turns(conversations, symbol_bits)
    heads = scanned.where(F.col("i") < HEADS - 1).join(parts, ["conv_id", "task"]).withColumn("place", F.col("before") + F.col("i")).where(F.col("place") < HEADS - 1)
    heads = written(heads.select("conv_id", "place", _shifted_sum("carry", "before", "sum").alias("sum"), "role", "text"), "heads")
    sums = heads.groupBy("conv_id").agg(*(F.max(F.when(F.col("place") == k, F.col("sum"))).alias(f"sum{k}") for k in range(HEADS - 1)))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).join(sums, "conv_id")
    whole = whole.select("*", heads_of(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    base = whole.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(f"sum{k}").alias(f"base{k}") for k in range(HEADS - 1)))

    def upto(name: str, n: Column) -> Column:
        """The sum of the first n turns."""
        return F.coalesce(F.element_at(F.array(F.lit(0), *(name + str(k) for k in range(HEADS - 1))), (n + 1).cast("int")), F.lit(0))

    m = F.least(F.col("h"), F.coalesce(F.col("base_n"), F.lit(0)))
    told = whole.join(base, "base", "left").select("conv_id", "base", "h", m.alias("m"), (m + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), upto("base", m).alias("head"), upto("sum", F.least(F.col("h"), F.col("n"))).alias("cut"))
    told = written(told, "conversations")

    place = F.col("before") + F.col("i")
    own = scanned.join(parts.join(told, "conv_id"), ["conv_id", "task"]).where(place >= F.col("h")).withColumn("depth", F.col("m") + place - F.col("h") + 1)
    own = own.withColumn("sums", _rebuilt_sum("carry", "before", "sum", "cut", F.col("h") - F.col("m"), "head", "t", "depth"))
    own = own.select("conv_id", "depth", "sums.fp", "sums.prev", "role", "text", (F.col("depth") == F.col("length")).alias("is_end"))
    before = heads.select("conv_id", (F.col("place") + 1).alias("place"), F.col("sum").alias("prev"))
    first = heads.where(F.col("conv_id") % HUNDRED == 0).join(before, ["conv_id", "place"], "left").withColumnRenamed("conv_id", "base")
    taken = told.where(F.col("m") > 0).join(first, "base").where(F.col("place") < F.col("m")).withColumn("depth", F.col("place") + 1)
    taken = taken.select("conv_id", "depth", F.col("sum").alias("fp"), F.coalesce("prev", F.lit(0)).alias("prev"), "role", "text", (F.col("depth") == F.col("length")).alias("is_end"))
    return own.unionByName(taken), told.select("conv_id", "length")


def split_groups(rows: DataFrame) -> DataFrame:
    """rows with the number of their variant within the group (split) and of the turn before (psplit): 0 for all, unless fingerprints collide."""
    rows = rows.select("*", F.lit(0).alias("split"), F.lit(0).alias("psplit"))
    key, variant = ["depth", "fp"], ["depth", "fp", "prev", "psplit", "role", "text"]
    clash = rows.groupBy(*variant).agg(F.count("*").alias("n")).groupBy(*key).count().where("count > 1").select(*key)
    found = written(clash, "clashes")
    known = None
    while not found.isEmpty():
        variants = rows.join(found, key, "left_semi").groupBy(*variant).agg(F.min("conv_id").alias("least"))
        numbered = variants.withColumn("new", F.row_number().over(Window.partitionBy(*key).orderBy("least")) - 1).where("new > 0").drop("least")
        moved = written(rows.join(numbered, variant).select("conv_id", "depth", F.col("new").alias("split")), "splits")
        if known is not None and moved.exceptAll(known).isEmpty() and known.exceptAll(moved).isEmpty():
            break
        known = moved
        rows = rows.drop("split", "psplit").join(moved, ["conv_id", "depth"], "left")
        rows = rows.join(moved.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("split").alias("psplit")), ["conv_id", "depth"], "left").fillna(0, ["split", "psplit"])
        found = written(rows.groupBy(*variant).agg(F.count("*").alias("n")).groupBy(*key).count().where("count > 1").select(*key), "clashes")
    return rows


def ends_digest(ends: DataFrame) -> DataFrame:
    """The SHA-256 of each node's ids, in order and comma-joined: tasks pack the ids of a range first, and rows of packed ids are then read in turn."""
    key = ["depth", "fp", "split"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            ids = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
            new = np.logical_or.reduce([np.concatenate([[True], c[1:] != c[:-1]]) for c in columns])
            at = [*np.flatnonzero(new).tolist(), len(ids)]
            cuts = [c for a, b in zip(at, at[1:]) for c in range(a, b, ENDS)]
            texts = [",".join(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[cuts]) for c in columns), batch.column("conv_id").take(pa.array(cuts)), pa.array(texts, pa.string())], names=[*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, hashlib.sha256()
        for batch in batches:
            out = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if k != last:
                    if last is not None:
                        out.append((*last, sha.hexdigest()))
                    last, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
        if last is not None:
            yield _digests([(*last, sha.hexdigest())])

    packed = ends.repartitionByRange("conv_id").sortWithinPartitions(*key, "conv_id").select(*key, "conv_id").mapInArrow(pack, "depth long, fp long, split int, first long, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, fp long, split int, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["depth", "fp", "split", "ends_sha256"])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Sum leaves and saved over each node's subtree. A round doubles the distance summed over: add the sums of the nodes that far below, then jump twice as far."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    table, far = nodes, 1
    while far <= deepest:
        below = table.where(F.col("depth") >= far)
        added = below.groupBy((F.col("depth") - far).alias("depth"), F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = below.select((F.col("depth") + far).alias("depth"), F.col("conv_id").alias("up"), F.col("up").alias("next"))
        table = table.join(added, ["depth", "conv_id"], "left").select("depth", "conv_id", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        table = written(table.join(jump, ["depth", "up"], "left").select("depth", "conv_id", F.col("next").alias("up"), "leaves", "saved"), "rollup")
        far *= 2
    return table.select("depth", "conv_id", "leaves", "saved")


def prefix_trie(conversations: DataFrame, symbol_bits: int = 60) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    Rows without conv_id take no part. Turns are ordered by turn, a null first, those of one number by the MD5 of role and text, so repeated rows are turns of
    their own. A null role or text is the empty text. Conversations without a turn don't exist, but one may be rebuilt without any: it is a member of the
    root only. No rows give no node, not even a root. Further columns are dropped. ``symbol_bits`` is for tests: with few, fingerprints collide.
    """
    rows, told = rebuilt_turns(conversations, symbol_bits)
    rows = split_groups(rows)
    variants = rows.groupBy("depth", "fp", "split", "prev", "psplit", "role", "text").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    root = told.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("split"), F.lit(None).cast("long").alias("prev"), F.lit(0).alias("psplit"), F.lit(0).alias("chars"), "n", "conv_id")
    nodes = written(variants.select("depth", "fp", "split", "prev", "psplit", F.char_length("text").alias("chars"), "n", "conv_id").unionByName(root), "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("psplit"), F.col("conv_id").alias("up"))
    linked = written(nodes.join(above, ["depth", "prev", "psplit"], "left"), "linked")
    children = linked.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("conv_id")).agg(F.count("*").alias("n_children"))
    linked = written(linked.join(children, ["depth", "conv_id"], "left").fillna(0, ["n_children"]), "linked")
    sums = rolled_up(linked.select("depth", "conv_id", "up", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved")))
    empty = told.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("split"), "conv_id")
    digests = ends_digest(rows.where("is_end").select("depth", "fp", "split", "conv_id").unionByName(empty))
    out = linked.join(sums, ["depth", "conv_id"]).join(digests, ["depth", "fp", "split"], "left")
    return out.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(SHA_EMPTY)).alias("ends_sha256"))
