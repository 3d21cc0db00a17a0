import random

import numpy as np
import pyarrow as pa
import pytest

from passagelake.llm import lm


@pytest.mark.parametrize("at_once", [1, 16 << 20])
def test_words_of_many_texts(monkeypatch, at_once):
    monkeypatch.setattr(lm, "BYTES_AT_ONCE", at_once)
    rng = random.Random(1)
    odd = [b"", b" ", b" A b\t\nC ", b"a\x1cb\x0b\x0cc", b"\xff\xfe Q", "É \xa0A".encode()] + [bytes(rng.choices([0, 9, 10, 11, 12, 13, 28, 31, 32, 32, 65, 90, 97, 133, 160, 255], k=rng.randint(0, 9))) for _ in range(2000)]
    words, sizes = [], []
    for tokens, of_each in lm.tokens_of(pa.array(odd, pa.binary())):
        words += tokens.view(pa.binary()).to_pylist()
        sizes += of_each.tolist()
    want = [[*x.lower().split(), b""] for x in odd]
    assert words == [w for x in want for w in x] and sizes == [len(x) for x in want]
    assert list(lm.tokens_of(pa.array([], pa.binary()))) == []
    some = pa.array([b"b", b"", b"c"], pa.binary()).view(pa.string())
    assert lm.numbers_of(pa.array(["c", "x", ""]), some).tolist() == [2, -1, 1] and lm.numbers_of(pa.array(["c"]), some[:0]).tolist() == [-1]


def test_a_step_is_the_sum_over_its_tokens():
    counts = np.arange(40, 10, -1)
    known = lm.Vocabulary([b"w%d" % i for i in range(30)], counts, int(counts.sum()), 30)
    model, rng = lm.LogBilinear(known.shares(), known.grouped_shares()), np.random.default_rng(3)
    model.set(model.flat + rng.normal(0, 0.3, len(model.flat)))
    before, word = rng.integers(0, model.n + 1, (50, 2)), rng.integers(0, model.n, 50)
    trainer = lm.Trainer(model, 1)
    noise = np.minimum(np.searchsorted(trainer.edges, np.random.default_rng(1).random(lm.NOISE)), model.n - 1)
    context, target, bias, mix = (x.astype(float) for x in (model.context, model.target, model.bias, model.mix))
    to = [np.zeros_like(x) for x in (context, target, bias, mix)]
    for c, w in zip(before, word):
        q, to_q = sum(context[c[i]] @ mix[i] for i in range(2)), np.zeros(lm.SIZE)
        for j, real in [(w, 1), *((x, 0) for x in noise)]:
            off = real - 1 / (1 + np.exp(trainer.log_noise[j] - q @ target[j] - bias[j]))
            to[1][j] += off * q
            to[2][j] += off
            to_q += off * target[j]
        for i in range(2):
            to[0][c[i]] += to_q @ mix[i].T
            to[3][i] += np.outer(context[c[i]], to_q)
    want = [x + lm.RATE * g / np.sqrt(1e-2 + g * g) for x, g in zip((context, target, bias, mix), (g / 50 for g in to))]
    trainer.class_step(before, word, np.zeros((50, lm.SIZE), np.float32))
    for got, x in zip((model.context, model.target, model.bias, model.mix), want):
        assert got == pytest.approx(x, abs=1e-4)
