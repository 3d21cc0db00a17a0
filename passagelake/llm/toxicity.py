"""Toxicity from a weighted lexicon.

Texts and lexicon are folded alike: case, accents and compatibility forms go, look-alike letters of other scripts and
digits or signs used as letters become one Latin letter, all else becomes a space. The lexicon holds whole words and
word beginnings, weighted by the log-odds of their document counts in labelled rows. An Aho-Corasick automaton finds all
entries in one pass. Phrases that hold an entry but mark clean texts are exceptions and take its weight back. The sum of weights over
a power of the length goes through a logistic curve; curve and power are fitted together, with labels as frequent as they are among all usable rows.

The classifier is fitted on MOST_LABELLED rows of each label at most, the ones with the smallest hashes; their texts are counted
by Spark, and only entries that pass the thresholds come to the driver; the sample's bound holds their number.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

MOST_LABELLED = 8000
LEAST_TEXTS = 5
LEAST_CLEAN = 5
LEAST_ODDS = 20.0
#: Entries of the first round are in this part of the toxic texts. A round that adds nothing halves it, down to LEAST_TEXTS texts.
FIRST_SHARE = 0.03
NEARLY_ALL = 0.95
COUNTED_AT_ONCE = 150_000
BEGINNINGS = (4, 5, 6, 7)
EMPTY = 0.01

#: Letters of other scripts, digits and signs that pass for a Latin letter (fixed values). i, l and 1 can't be told apart and so are one letter.
LOOK_ALIKES = {
    "a": "аα@4ɑ", "b": "вβƄ" + "8", "c": "сϲ¢", "d": "ԁ", "e": "еε3€", "g": "ց" + "9",
    "h": "һн", "i": "l1|!іιıӏ", "j": "ј", "k": "кκ", "m": "м", "n": "ηո", "o": "0оοօø",
    "p": "рρ", "q": "ԛ", "s": "5$ѕ", "t": "7+тτ", "u": "υս", "v": "νѵ", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "2",
}


class Fold(dict):
    """A table for str.translate, filled as characters come up."""

    alike = {ord(c): latin for latin, cs in LOOK_ALIKES.items() for c in cs}

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).casefold()):
            if latin := self.alike.get(ord(c)):
                out += latin
            elif not unicodedata.combining(c):
                out += c if c.isalpha() else " "
        self[code] = out
        return out


FOLD = Fold()


#: Signs that stand for letters only between letters; elsewhere they are punctuation.
LOOSE_SIGNS = re.compile(r"(?<![^\W_])[!$@|+]+|[!$@|+]+(?![^\W_])")


def folded(text: str) -> str:
    """The text's words as they are looked up, one space before, between and after them."""
    return f" {' '.join(LOOSE_SIGNS.sub(' ', text).translate(FOLD).split())} "


def entries(words: set[str]) -> set[str]:
    """Whole words as `` word ``, beginnings as `` word``: the patterns of the automaton."""
    out = {f" {w} " for w in words if len(w) > 2}
    for n in BEGINNINGS:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: dict[str, float] = field(default_factory=dict)
    #: Of the curve: at 0, for the logarithm of the sum of weights, and for that of the length.
    curve: tuple[float, float, float] = (-10.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for pattern, w in [*self.weights.items(), *((p, -w) for p, w in self.exceptions.items())]:
            a.add_word(pattern, w)
        if len(a):
            a.make_automaton()
        return a

    def probability(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(_features(found) @ np.array(self.curve))))


def _features(found: np.ndarray) -> np.ndarray:
    """For the curve: 1, and the logarithms of the sum of weights and of the length."""
    return np.stack([np.ones(len(found)), np.log(np.maximum(found[:, 0], 0) + EMPTY), np.log(found[:, 1] + 2)], axis=1)


def strengths(texts: Iterable[str | None], automaton) -> np.ndarray:
    """The sum of matched weights and the number of words of each text."""
    return np.array([_strength(t, automaton) for t in texts], dtype=np.float64).reshape(-1, 2)


def _strength(text: str | None, automaton) -> tuple[float, int]:
    plain = folded(text or "")
    return (sum(w for _, w in automaton.iter(plain)) if len(automaton) else 0.0), len(plain.split())


def labelled_sample(labels: DataFrame, key: str, label: str, usable: Column, most: int = MOST_LABELLED) -> DataFrame:
    """key and y of ``most`` rows of each label at most, chosen by hash. Nulls and other labels are left out; of repeated keys the larger label counts."""
    rows = _labelled(labels, key, label, usable)
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(most) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def _labelled(labels: DataFrame, key: str, label: str, usable: Column) -> DataFrame:
    return labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & usable).groupBy(key).agg(F.max(label).cast("int").alias("y"))


def _texts(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts of the sample with y. The sample's bound is what allows the broadcast."""
    return docs.select(key, text).join(F.broadcast(sample), key).where(F.col(text).isNotNull()).select("y", text)


def _entry_counts(texts: DataFrame, taken: dict[str, float]) -> DataFrame:
    """Of each entry, how many of the texts hold it in which no taken entry is; the empty entry counts these texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])

        automaton, counts = Lexicon(taken).automaton(), Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if not _strength(text, automaton)[0] > 0:
                    counts.update(entries(set(folded(text).split())))
                    counts[""] += 1
                if len(counts) > COUNTED_AT_ONCE:
                    yield out()
                    counts.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def _begins(entry: str, among: dict | set) -> bool:
    """True if one of ``among`` is the entry's beginning, or the entry."""
    return any(entry[:k] in among for k in range(1, len(entry) + 1))


def _specific(strong: list, n: dict[int, int]) -> dict[str, tuple[int, int]]:
    """Of nested entries the one with the most evidence, or the longest that still has nearly all its texts."""
    counts = {r["entry"]: (r["toxic"], r["clean"]) for r in strong}
    longer: dict[str, list[str]] = {}
    for x in counts:
        for k in range(1, len(x) + 1):
            if x[:k] in counts:
                longer.setdefault(x[:k], []).append(x)
    out: dict[str, tuple[int, int]] = {}
    beginnings: set[str] = set()
    for e in sorted(counts, key=lambda e: (-counts[e][0] * log_odds(*counts[e], n[1], n[0]), len(e), e)):
        if e not in beginnings and not _begins(e, out):
            best = max((x for x in longer[e] if counts[x][0] >= NEARLY_ALL * counts[e][0]), key=lambda x: (len(x), x))
            out[best] = counts[best]
            beginnings.update(best[:k] for k in range(1, len(best) + 1))
    return out


def _two_counts(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    keys = list(set(counts[0]) | set(counts[1]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], names=["entry", "clean", "toxic"])


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def fit_lexicon(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """Learn from rows of ``labels`` where ``usable`` holds. Without rows of both labels, the lexicon is empty and every score 0."""
    rows = {r["y"]: r["count"] for r in _labelled(labels, key, label, usable).groupBy("y").count().collect()}
    texts = written(_texts(docs, labelled_sample(labels, key, label, usable), key, text), "labelled")  # 2 MOST_LABELLED rows at most, read several times
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon()
    weights: dict[str, float] = {}
    odds = ((F.col("toxic") + 0.5) / (n[1] + 1)) / ((F.col("clean") + 0.5) / (n[0] + 1))
    clean = written(_entry_counts(texts.where("y = 0"), {}).withColumnRenamed("n", "clean"), "clean")
    toxic, share = texts.where("y = 1"), FIRST_SHARE
    counted = None
    while True:
        # Words of toxic texts that an entry explains already, such as those of their copies, are no evidence.
        if counted is None:
            counted = written(_entry_counts(toxic, weights).where(F.col("n") >= LEAST_TEXTS).withColumnRenamed("n", "toxic"), "toxic")
            left = counted.where(F.col("entry") == "").agg(F.max("toxic")).first()[0] or 0
        least = max(LEAST_TEXTS, share * left)
        strong = counted.where((F.col("entry") != "") & (F.col("toxic") >= least)).join(clean, "entry", "left").fillna(0, ["clean"]).where(odds >= LEAST_ODDS).collect()
        new = {e: c for e, c in _specific(strong, n).items() if not _begins(e, weights)}
        if new:
            weights |= {e: log_odds(toxic, clean, n[1], n[0]) for e, (toxic, clean) in new.items()}
            counted = None
        elif least <= LEAST_TEXTS:
            break
        share /= 1 if new else 2
    found = Lexicon(weights)
    found.exceptions = _exceptions(texts, found)
    patterns = (found.weights, found.exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(*patterns).automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, strengths((x.as_py() for x in batch.column(1)), automaton).T)], names=["y", "x", "words"])

    points = texts.mapInArrow(measure, "y int, x double, words double").toPandas()
    y = points["y"].to_numpy()
    found.curve = _logistic(_features(points[["x", "words"]].to_numpy()), y, np.where(y == 1, rows[1] / n[1], rows[0] / n[0]))
    return found


def _exceptions(texts: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """Two-word phrases round an entry that clean texts use and toxic ones hardly do."""
    weights = lexicon.weights

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entry(word: str) -> str | None:
            spaced = f" {word} "
            return next((spaced[:k] for k in range(2, len(spaced) + 1) if spaced[:k] in weights), None)

        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = folded(text.as_py()).split()
                hits = {w: e for w in set(words) if (e := entry(w))}
                found = set()
                for a, b in zip(words, words[1:]) if hits else ():
                    for e in {hits.get(a), hits.get(b)} - {None}:
                        found.add(f"{e}\t {a} {b} ")
                counts[y].update(found)
            yield _two_counts(counts)

    counted = texts.mapInArrow(phrases, "entry string, clean bigint, toxic bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kept = counted.where((F.col("clean") >= LEAST_CLEAN) & (F.col("clean") >= 5 * F.col("toxic"))).orderBy(F.desc("clean"), "entry").collect()
    out: dict[str, float] = {}
    for r in kept:
        entry, phrase = r["entry"].split("\t")
        out[phrase] = out.get(phrase, 0.0) + weights[entry]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method over rows that weigh ``each``."""
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (each * (y - p)) - ridge * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) for each whole text.

    A null or empty text scores as one without matches. Other columns pass through, repeated rows repeat, an empty table gives an empty result.
    """
    others = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    at = [f.name for f in others].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            score = lexicon.probability(strengths((x.as_py() for x in batch.column(at)), automaton))
            new = [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "score", "predicted"])

    schema = docs.select(*(f.name for f in others)).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())
    return docs.select(*(f"`{f.name}`" for f in others)).mapInArrow(run, schema)
