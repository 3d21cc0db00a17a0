import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, size):
    most = min(math.isqrt((1 << 62) // size), (1 << 31) - 1)
    kept = [(v, (l + 1) % 10 if v % 7 == 0 else l, [max(min(math.floor(256 * x), most), -most) for x in e]) for v, l, e in rows if None not in (v, l, e) and all(x is not None and math.isfinite(x) for x in e)]
    x = np.array([e + [0] * (size - len(e)) for _, _, e in kept], np.int64).reshape(-1, size)
    ids, labels, anchors, out = np.array([r[0] for r in kept]), np.array([r[1] for r in kept]), {}, []
    for i, (v, l, e) in enumerate(kept):
        if v % 100 == 0:
            anchors[v] = min(anchors.get(v, (l, e, i)), (l, e, i))
    for a, (l, _, i) in anchors.items():
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != a]
        for j in [j for j in order if labels[j] == l][:5]:
            p = int(score[j])
            found = [q for q in order if labels[q] != l and 30 * p <= 100 * int(score[q]) <= 90 * p][:10]
            out += [(int(a), int(ids[j]), k, int(ids[q]), p, int(score[q])) for k, q in enumerate(found, 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.hard_negatives(negatives.embedding_vectors(df, label), F.col("vec_id") % 100 == 0).collect()))


def test_against_brute_force_with_a_hot_vector_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 4)
    rng = random.Random(1)
    hot = [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i if rng.random() > 0.03 else None, rng.choice([None, 0, 1, 2, 2, 2, 2, 3]), None if rng.random() < 0.02 else hot if rng.random() < 0.3 else [rng.choice([None, math.nan, math.inf, 1e12, 2.0]) if rng.random() < 0.003 else rng.gauss(0, 1) for _ in range(rng.choice([6, 6, 6, 4, 0]))]) for i in range(-300, 1200)]
    rows += rows[250:420]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute([tuple(r) for r in df.collect()], 6)
    assert len(want) > 300 and mined(df.withColumn("x", F.lit(1)).withColumn("score", F.lit("s"))) == want


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    assert mined(df) == brute([tuple(r) for r in df.collect()], 64)


def test_no_rows_and_one_label(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, 1, [1.0]), (1, 1, [2.0])], SCHEMA)) == []


def test_pairs_are_discarded_early_and_none_that_counts():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 32)) * np.geomspace(400, 4, 32)).astype(np.int64)
    turn = np.ascontiguousarray(np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1])
    side = negatives.Side(np.arange(3000), np.zeros(3000, int), x, turn)
    anchors, slack = side.take(slice(0, 20)), negatives.slack_of(turn)
    exact = anchors.x @ x.T
    reach = np.sort(exact, 1)[:, -5].astype(float)
    at, alive, low, high = negatives.bounds(anchors, side, np.ones(exact.shape, bool), slack, reach, np.full(20, math.inf))
    whole = np.zeros(exact.shape, bool)
    whole[:, at] = alive
    assert whole[exact >= reach[:, None]].all() and len(at) < 1500
    assert (low <= exact[:, at]).all() and (high >= exact[:, at]).all()


@pytest.mark.parametrize("k", [1, 3])
def test_copies_within_a_block(k):
    x = np.array([[1, 2]] * 6 + [[3, 4]] * 2)
    side = negatives.Side(np.array([9, 3, 5, 1, 7, 2, 4, 8]), np.array([0, 0, 0, 0, 0, 1, 0, 0]), x, np.eye(2))
    kept = sorted(negatives.without_copies(side, k).ids.tolist())
    assert kept == sorted(sorted([9, 3, 5, 1, 7])[: k + 1] + [2] + [4, 8][: k + 1])
