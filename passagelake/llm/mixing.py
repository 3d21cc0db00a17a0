"""Mixing sources to target weights by hierarchical budgeting.

The tree's levels are columns (domain, language, source). A budget of tokens goes down the tree in proportion to the weights. A
node can take what its leaves hold times the largest number of epochs; what it can't take goes to its siblings by their
weights, and only what they can't take either to its parent's siblings. Each leaf then gives whole seeded epochs and, of the
last, the prefix nearest to its budget.

Leaves are few by nature (MOST_LEAVES at most, or an error); rows never come to the driver. The prefix of a leaf ends at a hash value,
found from sums by hash bucket, so that choosing rows is a comparison with a broadcast row of their leaf and no shuffle. Only rows that have
that very value, which are alike in all columns but for chance, are counted off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .sharding import bucket_count

MOST_LEAVES = 50_000
HASH_BITS = 60
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_out(amount: float, children: Sequence[tuple[float, float]]) -> list[float]:
    """Split amount over (weight, capacity) children by weight; what a child can't take goes to those that still can."""
    given = [0.0] * len(children)
    open_ = [i for i, (w, cap) in enumerate(children) if w > 0 and cap > 0]
    left = amount
    while open_ and left > 0:
        total = sum(children[i][0] for i in open_)
        full = [i for i in open_ if given[i] + left * children[i][0] / total >= children[i][1]]
        if not full:
            for i in open_:
                given[i] += left * children[i][0] / total
            break
        before = sum(given)
        for i in full:
            given[i] = children[i][1]
        left -= sum(given) - before
        closed = set(full)
        open_ = [i for i in open_ if i not in closed]
    return given


def budgets(leaves: Mapping[tuple, int], weights: Sequence[Mapping[object, float]], amount: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. leaves: a path of names and its tokens; weights: for each level, names and weights (a name not listed weighs 1)."""
    out: dict[tuple, int] = {}

    def down(prefix: tuple, some: dict[tuple, int], amount: float) -> None:
        depth = len(prefix)
        if depth == len(weights):
            out[prefix] = int(amount + 0.5)
            return
        under: dict[object, dict[tuple, int]] = {}
        for p, n in some.items():
            under.setdefault(p[depth], {})[p] = n
        names = sorted(under, key=lambda x: (x is None, str(x)))
        below = [under[name] for name in names]
        children = [(float(weights[depth].get(name, 1.0)), float(sum(b.values()) * max_epochs)) for name, b in zip(names, below)]
        for name, b, part in zip(names, below, share_out(amount, children)):
            down((*prefix, name), b, part)

    down((), dict(leaves), float(amount))
    return out


def epoch_hash(key: Column, tie: Column, seed: int, epoch: Column) -> Column:
    """60 bits of md5 of seed, epoch and key; without a key, tie stands for it."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.concat(F.lit("~"), tie.cast("string"))))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def plan_mixture(docs: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[object, float]], share: float, max_epochs: int, tokens: Column, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """One row for each leaf: the levels, leaf_tokens, budget, epochs (whole ones), cutoff and cutoff_tie (where the last epoch's prefix ends by hash, or -1), and cutoff_rows (how many rows of just these values it takes).

    share: the whole budget as a share of all tokens. A row's middle token decides whether a prefix takes it.
    """
    spark = docs.sparkSession
    rows = written(docs.select(*levels, F.col(key).alias("_key"), _tie(docs).alias("_t"), tokens.alias("_tokens")), "mixture")
    leaves = rows.groupBy(*levels).agg(F.sum("_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("_rows"))
    found = leaves.limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    sizes = {tuple(r[c] for c in levels): r["leaf_tokens"] for r in found}
    amounts = budgets(sizes, weights, int(share * sum(sizes.values())), max_epochs)
    table = [(*path, size, amounts[path], amounts[path] // size if size else 0) for path, size in sizes.items()]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in levels), "leaf_tokens bigint, budget bigint, epochs bigint"])
    budget = spark.createDataFrame(table, schema)

    # MOST_LEAVES rows at most: small enough to broadcast.
    shift = HASH_BITS - (bucket_count(sum(r["_rows"] for r in found)).bit_length() - 1)
    joined = _with_leaf(rows, budget, levels)
    placed = joined.withColumn("_h", epoch_hash(F.col("_key"), F.col("_t"), seed, F.col("epochs"))).withColumn("_b", F.shiftright("_h", shift))
    leaf = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_l{i}") for i, c in enumerate(levels)]
    placed = placed.select(*leaf, "_h", "_t", "_b", "_tokens", (F.col("budget") - F.col("epochs") * F.col("leaf_tokens")).alias("_rest"))
    names = [f"_l{i}" for i in range(len(levels))]
    sums = placed.groupBy(*names, "_b").agg(F.sum("_tokens").alias("_sum"))
    offset = F.sum("_sum").over(Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*names, "_b", F.coalesce(offset, F.lit(0)).alias("_offset"))
    in_bucket = Window.partitionBy(*names, "_b").orderBy("_h", "_t")
    alike = Window.partitionBy(*names, "_b", "_h", "_t").orderBy("_tokens")
    ended = placed.withColumns({"_end": F.sum("_tokens").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(alike)}).join(sums, [*names, "_b"])
    taken = ended.where((F.col("_rest") > 0) & (2 * (F.col("_offset") + F.col("_end")) - F.col("_tokens") <= 2 * F.col("_rest")))
    cutoffs = taken.groupBy(*names).agg(F.max(F.struct("_h", "_t", "_k")).alias("_last"))
    named = budget.select("*", *leaf).join(F.broadcast(cutoffs), names, "left").drop(*names)
    last = {c: F.coalesce(F.col(f"_last.{x}").cast("long"), F.lit(-1)) for c, x in (("cutoff", "_h"), ("cutoff_tie", "_t"), ("cutoff_rows", "_k"))}
    return written(named.withColumns(last).drop("_last"), "mixture-plan")


def _tie(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))


def _with_leaf(rows: DataFrame, plan: DataFrame, levels: Sequence[str]) -> DataFrame:
    """The columns of rows, then those of their leaf. Null names match."""
    right = plan.select(*(F.col(c).alias(f"_p_{c}") for c in levels), *(c for c in plan.columns if c not in levels))
    return rows.join(F.broadcast(right), [rows[c].eqNullSafe(right[f"_p_{c}"]) for c in levels]).drop(*(f"_p_{c}" for c in levels))


def mix_sources(docs: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[object, float]], share: float, max_epochs: int, tokens: Column, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """The rows of the mixture with a column epoch (from 0): a row appears once for each epoch that takes it, max_epochs times at most.

    Null level values are names of their own. Rows of equal keys are ordered by a hash of all their columns, which also stands for a null key; of rows that are alike in all, as many are
    taken as the budget wants. Rows of 0 tokens go with their neighbours in the order; a leaf of such rows alone gives none. Other columns pass through, but a column
    ``epoch`` is replaced. Columns of map type can't be hashed. Empty input gives an empty result.
    """
    docs = docs.drop("epoch")
    plan = plan_mixture(docs, levels, weights, share, max_epochs, tokens, key, seed)
    leaf = plan.select(*levels, *(F.col(c).alias(f"_m_{c}") for c in ("epochs", "cutoff", "cutoff_tie", "cutoff_rows")))
    joined = _with_leaf(docs, leaf, levels).withColumns({"_m_h": epoch_hash(F.col(key), _tie(docs), seed, F.col("_m_epochs")), "_m_t": _tie(docs)})
    h, t, cutoff, tie = (F.col(f"_m_{c}") for c in ("h", "t", "cutoff", "cutoff_tie"))
    at_end = (h == cutoff) & (t == tie)
    before = (h < cutoff) | ((h == cutoff) & (t < tie))
    given = joined.where(~at_end).withColumn("_m_more", before)

    # Rows alike in all that the cutoff divides: counted off in SALTS parts.
    edge = written(joined.where(at_end).withColumn("_m_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mixture-edge")
    place = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"_m_l{i}") for i, c in enumerate(levels)]
    names = [f"_m_l{i}" for i in range(len(levels))]
    edge = edge.select("*", *place)
    ahead = F.sum("_m_n").over(Window.partitionBy(*names).orderBy("_m_salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = edge.groupBy(*names, "_m_salt").agg(F.count("*").alias("_m_n")).select(*names, "_m_salt", F.coalesce(ahead, F.lit(0)).alias("_m_ahead"))
    rank = F.row_number().over(Window.partitionBy(*names, "_m_salt").orderBy(F.lit(0)))
    ended = edge.withColumn("_m_k", rank).join(counts, [*names, "_m_salt"]).withColumn("_m_more", F.col("_m_k") + F.col("_m_ahead") <= F.col("_m_cutoff_rows"))

    kept = [F.col(f"`{c}`") for c in docs.columns]
    both = given.select(*kept, "_m_epochs", "_m_more").unionByName(ended.select(*kept, "_m_epochs", "_m_more"))
    chosen = both.withColumn("_m_last", F.col("_m_epochs") - 1 + F.col("_m_more").cast("long")).where(F.col("_m_last") >= 0)
    return chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m_last")))).select(*kept, "epoch")
