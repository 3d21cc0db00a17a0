"""Language identification of mixed texts.

A word's script leaves the languages that were seen in that script. Each letter then adds the log-probability of the three
letters around it, which gives a score for each word and language, and Viterbi with a penalty for each switch labels the words, so
that a text in two languages falls into spans. The text's language is the one with the most letters.

Counts cover every text to learn from. Spark adds them up; what comes to the driver is one number for each language and
bucket, whatever the corpus size.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
MOST_LANGUAGES = 256
#: Letters of a script below this share of a language's don't make it a candidate there.
LEAST_SCRIPT_SHARE = 0.001
UNDETERMINED = "und"
CHARS_AT_ONCE = 400_000
DOCS_AT_ONCE = 1000

#: First code points of script ranges (fixed values). A range ends where the next begins; names may repeat.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_OF_RANGE = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS], dtype=np.int16)


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter or a mark that belongs to one."""
    return np.array([(c := chr(i)).isalpha() or unicodedata.category(c)[0] == "M" for i in range(0x110000)])


def lowered(text: str) -> str:
    """Lower case of the same length, so that positions hold."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Letters:
    """The letters of some texts: bucket of each, and where words and texts begin."""

    buckets: np.ndarray
    at: np.ndarray
    word_first: np.ndarray
    word_doc: np.ndarray
    word_script: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Letters:
        codes = np.frombuffer(("\0" + "\0".join(lowered(t) for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = letter_table()[codes]
        at = np.flatnonzero(letter)
        c = np.where(letter, codes, 32).astype(np.uint64)
        mixed = c[at - 1] * np.uint64(0x9E3779B1) ^ c[at] * np.uint64(0x85EBCA6B) << np.uint64(7) ^ c[at + 1] * np.uint64(0xC2B2AE35) << np.uint64(13)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        first = np.flatnonzero(~letter[at - 1])
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, at[first], side="left") if len(first) else np.empty(0, np.int64)
        script = _OF_RANGE[np.searchsorted(_STARTS, codes[at[first]], side="right") - 1]
        return cls((mixed >> np.uint64(48)).astype(np.int64), at, first, doc, script)

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.word_first, len(self.at)))


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.empty((BUCKETS, 0), np.float32))
    allowed: np.ndarray = field(default_factory=lambda: np.empty((len(SCRIPT_NAMES), 0), bool))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count all letters of all rows whose text and language aren't null. No such row: a model without languages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b in slices(pc.utf8_length(batch.column(1)).to_pylist(), CHARS_AT_ONCE):
                found = Letters.of(batch.column(1)[a:b].to_pylist())
                n = found.lengths()
                own = np.array(langs[a:b], dtype=object)[found.word_doc]
                for name in set(own.tolist()):
                    of_word = own == name
                    of_letter = np.repeat(of_word, n)
                    grams[name] = grams.get(name, 0) + np.bincount(found.buckets[of_letter], minlength=BUCKETS)
                    scripts[name] = scripts.get(name, 0) + np.bincount(found.word_script[of_word], weights=n[of_word], minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for name in grams:
            both = np.concatenate((grams[name], scripts[name]))
            cells = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(both[cells], pa.int64())], names=["lang", "cell", "n"])

    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = usable.mapInArrow(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model is built for {MOST_LANGUAGES}")
    dense = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)))
    dense[[names.index(x) for x in counts["lang"]], counts["cell"]] = counts["n"]
    grams, scripts = dense[:, :BUCKETS] + 0.5, dense[:, BUCKETS:]
    table = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32) if names else Model().table
    return Model(names, np.ascontiguousarray(table), (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= LEAST_SCRIPT_SHARE).T)


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, where doc says (in order) which text a word is of. All texts go forward a word at a time together."""
    n, languages = scores.shape
    if not n:
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    counts = np.diff(np.append(starts, n))
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")
    came, best = np.zeros((n, languages), bool), np.zeros(n, np.int64)
    v = scores[starts]
    for t in range(1, counts[0]):
        k = active[t]
        prev, at = v[:k], starts[:k] + t
        top = prev.argmax(1)
        switched = prev[np.arange(k), top, None] - penalty
        came[at], best[at] = switched > prev, top
        v[:k] = np.maximum(prev, switched) + scores[at]
    path, state = np.empty(n, np.int64), v.argmax(1)
    for t in range(counts[0] - 1, -1, -1):
        k = active[t]
        at, now = starts[:k] + t, state[:k]
        path[at] = now
        state[:k] = np.where(came[at, now], best[at], now)
    return path


def word_scores(texts: list[str], model: Model) -> tuple[Letters, np.ndarray]:
    found = Letters.of(texts)
    if not len(found.at):
        return found, np.empty((0, len(model.languages)), np.float32)
    scores = np.add.reduceat(model.table[found.buckets], found.word_first, axis=0)
    allowed = model.allowed[found.word_script]
    scores[~allowed & allowed.any(1, keepdims=True)] = -1e6
    return found, scores


@dataclass
class Labelled:
    """Words of some texts with their languages."""

    doc: np.ndarray
    letters: np.ndarray
    language: np.ndarray
    start: np.ndarray


def label_words(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> Labelled:
    parts = []
    for a, b in slices([len(t) for t in texts], CHARS_AT_ONCE):
        found, scores = word_scores(texts[a:b], model)
        offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a:b]]))) + 1
        parts.append((found.word_doc + a, found.lengths(), scores, found.at[found.word_first] - offset[found.word_doc]))
    if not parts:
        return Labelled(*(np.empty(0, np.int64) for _ in range(4)))
    doc, letters, scores, start = (np.concatenate(x) for x in zip(*parts))
    return Labelled(doc, letters, viterbi(scores, doc, penalty), start)


def predict(texts: pa.Array | list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> tuple[list[str], np.ndarray]:
    """Language and its share of the letters for each text. A column is read in parts."""
    share = np.zeros(len(texts))
    names = [UNDETERMINED] * len(texts)
    if not model.languages:
        return names, share
    size = len(model.languages)
    for a in range(0, len(texts), DOCS_AT_ONCE):
        part = texts[a : a + DOCS_AT_ONCE]
        some = [t or "" for t in (part.to_pylist() if isinstance(part, pa.Array) else part)]
        words = label_words(some, model, penalty)
        total = np.bincount(words.doc * size + words.language, weights=words.letters, minlength=len(some) * size).reshape(-1, size)
        top, letters = total.argmax(1), total.sum(1)
        for i in np.flatnonzero(letters).tolist():
            names[a + i] = model.languages[top[i]]
            share[a + i] = total[i, top[i]] / letters[i]
    return names, share


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and lang_score to the rows.

    Null and empty texts, and texts without a letter, are ``und`` with score 0. Other columns pass through, repeated rows repeat,
    empty input gives an empty result.
    """
    others = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score")]
    at = [f.name for f in others].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share = predict(batch.column(at), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(share)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    kept = docs.select(*(f"`{f.name}`" for f in others))
    return kept.mapInArrow(run, T.StructType([*others, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))


def language_spans(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and spans: runs of words of one language, with the position of the first letter. Texts without letters have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: list[list[dict]] = [[] for _ in texts]
            if model.languages:
                w = label_words(texts, model)
                first = np.flatnonzero(np.append(True, (w.doc[1:] != w.doc[:-1]) | (w.language[1:] != w.language[:-1]))) if len(w.doc) else []
                for i, n in zip(first, np.diff(np.append(first, len(w.doc)))):
                    out[w.doc[i]].append({"lang": model.languages[w.language[i]], "start": int(w.start[i]), "words": int(n)})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[key, "spans"])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField("spans", SPANS)]))
