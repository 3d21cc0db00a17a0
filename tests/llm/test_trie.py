import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns, nodes, children, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(list), {}, {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{r}\0{x}".encode()).hexdigest(), (r, x)))
    turns = {c: [x[-1] for x in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    digest = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if built[c] == k).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], digest(k, m)) for k, m in nodes.items())


def some_rows(low, high):
    rng = random.Random(3)
    rows = [(c if rng.random() < 0.98 else None, rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b", "aé\U0001f600"])) for c in range(low, high, 3) for _ in range(rng.choice([1, 2, 6, 9]))]
    return rows + [(300, i, "u", "hi") for i in range(3)] + rows[:5]


def test_against_brute_force_with_one_hot_conversation(spark):
    rows = some_rows(-205, 420) + [(100, i, "u", "x" * (i % 3)) for i in range(600)] + [(100, 7, "u", "same")] * 40
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({n: F.lit("x") for n in ("depth", "fp", "i", "n", "task", "sum", "h")})
    assert sorted(map(tuple, trie.prefix_trie(df).collect())) == brute(rows)


@pytest.mark.parametrize("bits", [0, 2])
def test_colliding_fingerprints_are_split(spark, bits):
    rows = some_rows(0, 90)
    assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), bits).collect())) == brute(rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, trie.prefix_trie(df).collect())) == brute([tuple(r) for r in df.collect()])


def test_no_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_modular_arithmetic():
    rng = random.Random(1)
    a, b = ([rng.randrange(trie.PRIME) for _ in range(500)] + [0, 1, trie.PRIME - 1] for _ in range(2))
    u = lambda x: np.array(x, np.uint64)
    assert trie.times(u(a), u(b)).tolist() == [x * y % trie.PRIME for x, y in zip(a, b)]
    assert trie.power(np.arange(300)).tolist() == [pow(trie.BASE, i, trie.PRIME) for i in range(300)]
    first = np.array([i - i % 7 for i in range(len(a))])
    assert trie.scan(u(a), first).tolist() == [sum(a[f : i + 1]) % trie.PRIME for i, f in enumerate(first)]
