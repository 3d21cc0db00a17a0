"""A log-bilinear language model trained with noise-contrastive estimation, and log-probabilities of whole texts.

The model predicts a word's vector from those of the words before it, on two levels. Its classes are the most frequent words, groups of
GROUP words that follow in frequency, and one class for all others. Within a group each word has a vector and a bias of its own, and its probability is
normalised over the group; within the last class it is the word's smoothed share. So probabilities add up to one over all known words and
one unknown. Words seen LEAST_COUNT times or more are modelled, so that the vocabulary grows with the corpus until the dictionary is full.

A task trains on the words of its rows some at a time: classes in small batches, then grouped words by group, where each word of the group is noise once
for each token, so that both are matrix products. Every task trains on all the words of its rows, from the same start, and Spark averages the parameters: those of classes by words seen, those of a
grouped word by its own occurrences. Counts are of all training texts. Only bounded things reach the driver: the parameters, and the
DICTIONARY most frequent words. The counts of all other words stay a table, which is joined with those words' occurrences.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_bytes, written

#: One more than the words that are classes of their own.
CLASSES = 1024
GROUP = 256
LEAST_COUNT = 8
CONTEXT = 2
SIZE = 24
NOISE = 64
#: Tokens of a step within a group.
GROUP_BATCH = 256
LEAST_BATCH, MOST_BATCH = 256, 4096
#: A batch is this part of the tokens trained on so far: steps are many at first and large later.
BATCH_PART = 64
#: Batches of classes to one pass over groups.
PASS_BATCHES = 48
#: Weight of what groups ask of the predicted vectors. It comes late, at the end of a pass, so that the whole of it can build up.
PULL = np.float32(0.2)
RATE = 0.3
GROUP_RATE = 0.3
SEED = 42
DICTIONARY = 200_000
#: Bytes of texts that are cut into words at once, unless one text is longer.
BYTES_AT_ONCE = 16 << 20
TOKENS_AT_ONCE = 200_000
ROWS_AT_ONCE = 20_000
#: Contexts whose scores of all classes are held at once: few, so that these stay in a core's cache.
CONTEXTS_AT_ONCE = 512
#: Pairs of contexts whose normalisers are kept as a table.
MOST_PAIRS = 9_000_000
#: Counts are put in steps of this many to a doubling to find where the dictionary ends.
STEPS = 8


def tokens_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words between ASCII white space, A-Z lower-cased, then the closing token, which is empty as no word is: those of some texts, and how many each text has."""
    for start, end in slices(pc.binary_length(texts).to_pylist(), BYTES_AT_ONCE):
        words = pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(start, end - start).view(pa.string())))
        words = pc.if_else(pc.equal(pc.binary_length(words), 0), words, pc.binary_join_element_wise(words, "", " "))
        words = pc.ascii_split_whitespace(words)  # a space at the end leaves an empty word
        yield words.flatten(), pc.list_value_length(words).to_numpy().astype(np.int64)


def numbers_of(tokens: pa.Array, words: pa.Array) -> np.ndarray:
    """Places of tokens among words; -1 for any other."""
    return pc.fill_null(pc.index_in(tokens, value_set=words), -1).to_numpy()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """token (binary) and c of all texts, as a table in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tokens, _ in tokens_of(batch.column(0)):
                counts = tokens.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values").view(pa.binary()), counts.field("counts")], names=["token", "c"])

    found = docs.select(text_bytes(F.col(text)).alias("text")).mapInArrow(count, "token binary, c bigint")
    return written(found.groupBy("token").agg(F.sum("c").alias("c")), "words")


@dataclass
class Vocabulary:
    """What tasks know of the counts: the most frequent words with theirs, and the totals."""

    words: list[bytes] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    total: int = 0
    distinct: int = 0

    @property
    def classes(self) -> int:
        """Words that are classes of their own."""
        return min(CLASSES - 1, len(self.words))

    @property
    def modelled(self) -> int:
        """Words that are classes or members of a group."""
        return max(self.classes, int(np.searchsorted(-self.counts, -LEAST_COUNT, "right")))

    @property
    def last(self) -> int:
        """The class of all other words."""
        return self.classes - (self.classes - self.modelled) // GROUP

    def numbered(self, most: int | None = None) -> pa.Array:
        """The first words, in order, to look numbers up in."""
        return pa.array(self.words[:most], pa.binary()).view(pa.string())

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        out = np.where(ids < self.classes, ids, self.classes + (ids - self.classes) // GROUP)
        out[(ids < 0) | (ids >= self.modelled)] = self.last
        return out

    def grouped_of(self, ids: np.ndarray) -> np.ndarray:
        """Numbers among the grouped words; -1 for any other."""
        return np.where((ids >= self.classes) & (ids < self.modelled), ids - self.classes, -1)

    def by_number(self) -> tuple[np.ndarray, np.ndarray]:
        """Both as tables, with a last row for -1."""
        ids = np.append(np.arange(len(self.words)), -1)
        return self.classes_of(ids).astype(np.int32), self.grouped_of(ids).astype(np.int32)

    def base_denominator(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def other_denominator(self) -> float:
        """Of the smoothed shares within the class of all other words and the unknown one."""
        own = int(self.counts[: self.modelled].sum())
        return (self.total - own) + 0.5 * (self.distinct - self.modelled) + 0.5

    def shares(self) -> np.ndarray:
        """Probabilities of the classes as counted; the last is that of all others."""
        p = np.concatenate((self.counts[: self.classes] + 0.5, self._by_group().sum(axis=1), [self.other_denominator()]))
        return p / p.sum()

    def grouped_shares(self) -> np.ndarray:
        """Probabilities of the grouped words within their groups as counted."""
        p = self._by_group()
        return (p / p.sum(axis=1, keepdims=True)).ravel()[: self.modelled - self.classes]

    def _by_group(self) -> np.ndarray:
        p = np.zeros((self.last - self.classes, GROUP))
        p.ravel()[: self.modelled - self.classes] = self.counts[self.classes : self.modelled] + 0.5
        return p


def vocabulary(counted: DataFrame, most: int = DICTIONARY) -> Vocabulary:
    """The totals and the ``most`` most frequent words at most: those above a count that a histogram of counts gives."""
    step = F.floor(F.log2("c") * STEPS)
    histogram = counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    kept, least = 0, None
    for r in histogram:
        kept += r["n"]
        if kept > most:
            break
        least = r["least"]
    rows = [] if least is None else counted.where(F.col("c") >= least).collect()
    rows.sort(key=lambda r: (-r["c"], bytes(r["token"])))
    return Vocabulary([bytes(r["token"]) for r in rows], np.array([r["c"] for r in rows], np.int64), sum(r["c"] for r in histogram), sum(r["n"] for r in histogram))


class LogBilinear:
    """Parameters as one vector: the classes' vectors as context, as target with their biases, a matrix for each place of the context, and the
    vectors and biases of grouped words, which start at their shares. A bias is its row's last value, so that it takes part in products with rows that end in 1."""

    def __init__(self, shares: np.ndarray, grouped_shares: np.ndarray, seed: int = SEED) -> None:
        self.n = len(shares)  # classes; class n - 1 is all other words, context n stands before a text
        self.shares = shares
        words = len(grouped_shares)
        self.shapes = [(self.n + 1, SIZE), (self.n, SIZE + 1), (CONTEXT, SIZE, SIZE), (words, SIZE + 1)]
        random = np.random.default_rng(seed)
        start = [random.normal(0, 0.1, (self.n + 1, SIZE)), np.column_stack((random.normal(0, 0.1, (self.n, SIZE)), np.log(shares)))]
        start += [np.stack([np.eye(SIZE) / CONTEXT] * CONTEXT), np.column_stack((np.zeros((words, SIZE)), np.log(grouped_shares)))]
        self.set(np.concatenate([x.ravel() for x in start]))

    def set(self, flat: np.ndarray) -> None:
        self.flat = flat.astype(np.float32)
        self._terms: list[np.ndarray] | None = None
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        parts = [x.reshape(s) for x, s in zip(np.split(self.flat, ends[:-1]), self.shapes)]
        self.context, self.target_rows, self.mix, self.grouped_rows = parts
        self.target, self.bias = self.target_rows[:, :SIZE], self.target_rows[:, SIZE]
        self.grouped, self.grouped_bias = self.grouped_rows[:, :SIZE], self.grouped_rows[:, SIZE]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Views of the parameters as tables of rows with SIZE values, and a bias where they have one."""
        return [(self.context, None), (self.target, self.bias), (self.mix.reshape(-1, SIZE), None), (self.grouped, self.grouped_bias)]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The predicted vectors for rows of classes before a word, the nearest first."""
        return sum(np.take(self.context @ self.mix[i], before[:, i], axis=0) for i in range(CONTEXT))

    def log_normalisers(self, before: np.ndarray) -> np.ndarray:
        """log of the sum of exp(score) over all classes for each row of before.

        A score is a sum of a term for each place and the bias, so the sum over classes is a product of rows of exp(term): one matrix product of the tables
        of two places gives it for all their pairs.
        """
        if self._terms is None:
            self._terms, self._tops, self._pairs = [], [], None
            for i in range(CONTEXT):
                term = (self.context @ self.mix[i]).astype(np.float64) @ self.target.T.astype(np.float64) + (self.bias if i == 0 else 0)
                self._tops.append(top := term.max(axis=1))
                self._terms.append(np.exp(term - top[:, None]))
            if CONTEXT == 2 and (self.n + 1) ** 2 <= MOST_PAIRS:
                with np.errstate(divide="ignore"):
                    self._pairs = (np.log(self._terms[0] @ self._terms[1].T) + self._tops[0][:, None] + self._tops[1]).astype(np.float32)
        if self._pairs is not None:
            return self._checked(before, np.take(self._pairs, before[:, 0].astype(np.int64) * (self.n + 1) + before[:, 1]))
        before, inverse = np.unique(before, axis=0, return_inverse=True)
        out = np.empty(len(before))
        for at in range(0, len(before), CONTEXTS_AT_ONCE):
            rows = before[at : at + CONTEXTS_AT_ONCE]
            product = math.prod((self._terms[i][rows[:, i]] for i in range(1, CONTEXT)), start=self._terms[0][rows[:, 0]])
            with np.errstate(divide="ignore"):
                out[at : at + CONTEXTS_AT_ONCE] = np.log(product.sum(axis=1)) + sum(self._tops[i][rows[:, i]] for i in range(CONTEXT))
        return self._checked(before, out)[inverse.ravel()]

    def _checked(self, before: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Where all products vanish (places that want quite unlike words), the sum is taken over whole scores."""
        for at in np.flatnonzero(~np.isfinite(found)):
            scores = self.predicted(before[at : at + 1]).astype(np.float64)[0] @ self.target.T + self.bias
            found[at] = np.log(np.exp(scores - scores.max()).sum()) + scores.max()
        return found

    def scores(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.empty(len(before), np.float32)
        for at in range(0, len(before), ROWS_AT_ONCE):
            some = slice(at, at + ROWS_AT_ONCE)
            out[some] = np.einsum("ij,ij->i", ending_in_one(self.predicted(before[some])), np.take(self.target_rows, word[some], axis=0))
        return out

    def log_within(self, before: np.ndarray, grouped: np.ndarray) -> np.ndarray:
        """Log-probabilities of grouped words, given their groups: one matrix product for the tokens of each group."""
        order, out = in_groups(grouped), np.empty(len(grouped), np.float32)
        grouped, q, total = grouped[order], ending_in_one(self.predicted(before[order])), np.empty(len(grouped), np.float32)
        for first, start, end in runs_of_groups(grouped, CONTEXTS_AT_ONCE):
            rows, vectors = slice(start, end), self.grouped_rows[first : first + GROUP]
            scores = q[rows] @ vectors.T
            own = scores[np.arange(end - start), grouped[rows] - first]
            top = scores.max()
            scores -= top
            sums = np.exp(scores, out=scores).sum(axis=1)
            if not sums.all():  # scores of one row are far below another's
                scores = q[rows] @ vectors.T
                top = scores.max(axis=1)
                sums = np.exp(scores - top[:, None]).sum(axis=1)
            out[order[rows]] = own - top
            total[order[rows]] = sums
        return out - np.log(total)


def ending_in_one(vectors: np.ndarray) -> np.ndarray:
    """Each vector with a 1 behind, for the bias."""
    out = np.empty((len(vectors), vectors.shape[1] + 1), vectors.dtype)
    out[:, :-1], out[:, -1] = vectors, 1
    return out


def in_groups(grouped: np.ndarray) -> np.ndarray:
    """Rows in the order of their groups, and of rows within them. Groups that fit in 16 bits are sorted by radix."""
    group = grouped // GROUP
    return np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")


def runs_of_groups(grouped: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """The first word of each group that occurs, and from where to where it does in the order of groups, ``most`` at a time."""
    group = grouped // GROUP
    edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else []
    for start, end in zip(edges, edges[1:]):
        for at in range(start, end, most):
            yield int(group[start]) * GROUP, at, min(at + most, end)


def falsely(scores: np.ndarray) -> np.ndarray:
    """What noise of such scores asks of them, in place: less their logistic function. A score whose exp overflows gives -1; the caller has numpy ignore that."""
    np.exp(scores, out=scores)
    scores += 1
    np.reciprocal(scores, out=scores)
    scores -= 1
    return scores


class Trainer:
    """Noise-contrastive estimation with Adagrad. A batch shares its noise classes, so that their steps are matrix products; noise within
    a group is each of its words once."""

    def __init__(self, model: LogBilinear, seed: int) -> None:
        self.m, self.random, self.trained = model, np.random.default_rng(seed), 0
        self.squares = [np.full(s, 1e-2, np.float32) for s in model.shapes[:3]] + [np.ones(model.shapes[3], np.float32)]
        self.times = np.zeros(len(model.grouped), np.int64)
        self.log_noise = np.log(NOISE * model.shares).astype(np.float32)
        self.edges = np.cumsum(model.shares)
        self.cells = [np.arange(math.prod(s)).reshape(s) for s in model.shapes[:2]]

    @staticmethod
    def _move(parameter: np.ndarray, squares: np.ndarray, gradient: np.ndarray, rate: float = RATE) -> None:
        """In place. What has no gradient stays."""
        squares += gradient * gradient
        gradient /= np.sqrt(squares)
        gradient *= rate
        parameter += gradient

    def _summed(self, i: int, rows: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """Gradients summed by row of a table of parameters."""
        cells = self.cells[i]
        sums = np.bincount(np.take(cells, rows, axis=0).ravel(), gradient.ravel(), cells.size)
        return sums.astype(np.float32).reshape(cells.shape)

    def within_groups(self, before: np.ndarray, grouped: np.ndarray) -> np.ndarray:
        """Steps for grouped words; the gradients of the predicted vectors are returned. Words move by each occurrence, as they are rare."""
        m, order = self.m, in_groups(grouped)
        q, sorted_, asked = ending_in_one(m.predicted(before[order])), grouped[order], np.empty((len(grouped), SIZE), np.float32)
        with np.errstate(over="ignore"):
            for first, start, end in runs_of_groups(sorted_, GROUP_BATCH):
                vectors, own = m.grouped_rows[first : first + GROUP], q[start:end]
                up = own @ vectors.T
                falsely(up)
                at = np.arange(end - start), sorted_[start:end] - first
                up[at] = 2 * up[at] + 1  # it is real once, and once noise
                np.matmul(up, vectors[:, :SIZE], out=asked[start:end])
                self._move(vectors, self.squares[3][first : first + GROUP], up.T @ own, GROUP_RATE)
        self.times += np.bincount(grouped, minlength=len(self.times))
        to_q = np.empty_like(asked)
        to_q[order] = asked
        return to_q

    def from_groups(self, before: np.ndarray, grouped: np.ndarray) -> np.ndarray:
        """Steps within groups; what each token's group asks of its predicted vector."""
        out, inside = np.zeros((len(grouped), SIZE), np.float32), np.flatnonzero(grouped >= 0)
        if len(inside):
            out[inside] = self.within_groups(before[inside], grouped[inside])
            out *= PULL
        return out

    def steps(self, before: np.ndarray, word: np.ndarray, grouped: np.ndarray) -> None:
        """Go once through tokens, in a seeded order. What groups ask is found for PASS_BATCHES batches at once, as parameters move less and less."""
        order, at = self.random.permutation(len(word)), 0
        before, word, grouped, told = before[order], word[order], grouped[order], 0
        while at < len(word):
            size = min(MOST_BATCH, max(LEAST_BATCH, self.trained // BATCH_PART))
            if at == told:
                told = at + PASS_BATCHES * max(size, self.trained // BATCH_PART)
                asked, first = self.from_groups(before[at:told], grouped[at:told]), at
            end = min(at + size if len(word) - at >= 2 * size else len(word), told)
            self.class_step(before[at:end], word[at:end], asked[at - first : end - first])
            self.trained += end - at
            at = end

    def step(self, before: np.ndarray, word: np.ndarray, grouped: np.ndarray) -> None:
        self.class_step(before, word, self.from_groups(before, grouped))

    def class_step(self, before: np.ndarray, word: np.ndarray, asked: np.ndarray) -> None:
        m, n = self.m, len(word)
        noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), m.n - 1).astype(word.dtype)
        own, others = np.take(m.target_rows, word, axis=0), m.target_rows[noise]
        others[:, SIZE] -= self.log_noise[noise]
        q = ending_in_one(m.predicted(before))
        with np.errstate(over="ignore"):
            up = 1 + falsely(np.einsum("ij,ij->i", q, own) - self.log_noise[word])
            down = falsely(q @ others.T)
        to_q = up[:, None] * own[:, :SIZE]
        to_q += down @ others[:, :SIZE]
        to_q += asked
        to_q /= n
        to_target = np.empty((n + NOISE, SIZE + 1), np.float32)
        np.multiply(q, up[:, None], out=to_target[:n])
        np.matmul(down.T, q, out=to_target[n:])
        to_target = self._summed(1, np.concatenate((word, noise)), to_target)
        to_target /= n
        # products of sums by class are sums of products, and classes are fewer than tokens
        by_class = [self._summed(0, before[:, i], to_q) for i in range(CONTEXT)]
        to_context = sum(x @ m.mix[i].T for i, x in enumerate(by_class))
        to_mix = np.stack([m.context.T @ x for x in by_class])
        self._move(m.target_rows, self.squares[1], to_target)
        self._move(m.context, self.squares[0], to_context)
        self._move(m.mix, self.squares[2], to_mix)


def contexts(classes: np.ndarray, first: np.ndarray, outside: int) -> np.ndarray:
    """The classes before each token, the nearest first; first: where texts begin. Before a text stands ``outside``."""
    place = np.arange(len(classes)) - np.repeat(first, np.diff(np.append(first, len(classes))))
    columns = []
    for i in range(1, CONTEXT + 1):
        shifted = np.full(len(classes), outside, classes.dtype)
        shifted[i:] = classes[:-i] if len(classes) > i else classes[:0]
        columns.append(np.where(place >= i, shifted, outside))
    return np.stack(columns, axis=1)


VALUES = [f"v{i}" for i in range(SIZE + 1)]


def _weighted(model: LogBilinear, seen: int, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the parameters multiplied by their weights, as batches; rows of no weight are left out."""
    first = 0
    for values, bias in model.tables():
        weight = times if values is model.grouped else np.full(len(values), seen)
        some = np.flatnonzero(weight)
        for at in range(0, len(some), ROWS_AT_ONCE):
            rows = some[at : at + ROWS_AT_ONCE]
            by = weight[rows].astype(np.float32)
            columns = [values[rows, i] * by for i in range(SIZE)] + [(np.zeros(len(rows), np.float32) if bias is None else bias[rows]) * by]
            yield pa.RecordBatch.from_arrays([pa.array(first + rows), pa.array(weight[rows].astype(np.float64)), *map(pa.array, columns)], names=["at", "weight", *VALUES])
        first += len(values)


def train(docs: DataFrame, known: Vocabulary, text: str = "text", seed: int = SEED) -> LogBilinear:
    """Train on every text of docs. Each task goes once through its rows; rows of parameters are averaged by tokens seen, those of grouped words by
    occurrences in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # DICTIONARY words at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        words, model = known.numbered(known.modelled), LogBilinear(known.shares(), known.grouped_shares(), seed)
        trainer, (classes_by_number, grouped_by_number) = Trainer(model, seed), known.by_number()
        texts: list[np.ndarray] = []
        seen = waiting = 0
        kind = np.uint16 if model.n < 1 << 16 else np.int32

        def go() -> None:
            ids = np.concatenate(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            classes = classes_by_number[ids].astype(kind)
            trainer.steps(contexts(classes, np.cumsum(sizes) - sizes, model.n), classes, grouped_by_number[ids])
            texts.clear()

        for batch in batches:
            for tokens, sizes in tokens_of(batch.column(0)):
                for ids in np.split(numbers_of(tokens, words), np.cumsum(sizes)[:-1]):
                    texts.append(ids)
                    seen, waiting = seen + len(ids), waiting + len(ids)
                    if waiting >= TOKENS_AT_ONCE:
                        go()
                        waiting = 0
        if waiting:
            go()
        yield from _weighted(model, seen, trainer.times)

    trained = docs.select(text_bytes(F.col(text)).alias("text")).mapInArrow(learn, f"at bigint, weight double, {', '.join(f'{v} float' for v in VALUES)}")
    rows = trained.groupBy("at").agg(*((F.sum(v) / F.sum("weight")).alias(v) for v in VALUES)).toPandas()
    model = LogBilinear(known.shares(), known.grouped_shares(), seed)
    at, values, first = rows["at"].to_numpy(), rows[VALUES].to_numpy(), 0
    for own, bias in model.tables():
        here = (at >= first) & (at < first + len(own))
        own[at[here] - first] = values[here, :SIZE]
        if bias is not None:
            bias[at[here] - first] = values[here, SIZE]
        first += len(own)
    return model


#: The model in this Python worker, by name: its tables of normalisers are kept from task to task.
_MODELS: dict[str, LogBilinear] = {}


def _model(known: Vocabulary, flat: np.ndarray, name: str) -> LogBilinear:
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = LogBilinear(known.shares(), known.grouped_shares())
        _MODELS[name].set(flat)
    return _MODELS[name]


LOCAL = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("token", T.BinaryType()), T.StructField("times", T.LongType()),
])


def score_texts(docs: DataFrame, counted: DataFrame, known: Vocabulary, model: LogBilinear, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    base_score: the log10 probability of the tokens by smoothed counts alone; score: by the model. Null texts count as empty: the closing token alone. A
    null key passes through and repeated rows repeat, as rows are told apart by number. Empty input gives an empty result;
    without training texts all probabilities are those of an unknown word.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, model.flat, uuid.uuid4().hex))  # DICTIONARY words at most, and the parameters
    ln10 = math.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, flat, name = shared.value
        model = _model(known, flat, name)
        words, (classes_by_number, grouped_by_number) = known.numbered(), known.by_number()
        logs = np.append(np.log10(known.counts + 0.5), 0.0)  # the last is for words that only the table knows
        base_log, other_log = math.log10(known.base_denominator()), math.log10(known.other_denominator())
        row = TaskContext.get().partitionId() << 40

        def measure(keys: pa.Array, tokens: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal row
            first = np.cumsum(sizes) - sizes
            classes, grouped = classes_by_number[ids], grouped_by_number[ids]
            before = contexts(classes, first, model.n)
            log_p = (model.scores(before, classes) - model.log_normalisers(before)) / ln10
            inside = np.flatnonzero(grouped >= 0)
            log_p[inside] += model.log_within(before[inside], grouped[inside]) / ln10
            other = classes == model.n - 1
            base = np.add.reduceat(logs[ids] - base_log, first)
            score = np.add.reduceat(log_p + np.where(other, logs[ids] - other_log, 0.0), first)
            in_dictionary = np.add.reduceat((ids >= 0).astype(np.int64), first)
            unknown = np.flatnonzero(ids < 0)
            found = tokens.take(pa.array(unknown)).dictionary_encode()
            distinct = max(1, len(found.dictionary))
            rare, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[unknown] * distinct + found.indices.to_numpy(), return_counts=True)
            n, m = len(sizes), len(rare)

            def with_rare(own: pa.Array, of_rare: pa.Array | None = None) -> pa.Array:
                return pa.concat_arrays([own, pa.nulls(m, own.type) if of_rare is None else of_rare])

            columns = [
                with_rare(keys),
                pa.array(row + np.concatenate((np.arange(n), rare // distinct))),
                with_rare(pa.array(sizes)),
                with_rare(pa.array(in_dictionary)),
                with_rare(pa.array(base)),
                with_rare(pa.array(score.astype(np.float64))),
                with_rare(pa.nulls(n, pa.binary()), found.dictionary.take(pa.array(rare % distinct)).view(pa.binary())),
                with_rare(pa.nulls(n, pa.int64()), pa.array(times.astype(np.int64))),
            ]
            row += n
            return pa.RecordBatch.from_arrays(columns, names=["key", *LOCAL.names])

        for batch in batches:
            keys = batch.column(0)
            for tokens, sizes in tokens_of(batch.column(1)):
                ids, edges = numbers_of(tokens, words), np.append(0, np.cumsum(sizes))
                for start, end in slices(sizes.tolist(), TOKENS_AT_ONCE):
                    at, size = int(edges[start]), int(edges[end] - edges[start])
                    yield measure(keys.slice(start, end - start), tokens.slice(at, size), ids[at : at + size], sizes[start:end])
                keys = keys.slice(len(sizes))

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *LOCAL.fields])
    local = written(docs.select(F.col(key), text_bytes(F.col(text)).alias("text")).mapInArrow(run, schema), "lm")
    rare = local.where(F.col("token").isNotNull()).select("row", "token", "times").join(counted, "token", "left")
    c = F.coalesce("c", F.lit(0))
    summed = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_known"))
    own = local.where(F.col("token").isNull()).join(summed, "row", "left")
    more = F.coalesce("_log", F.lit(0.0))
    return own.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def fit_and_score(docs: DataFrame, usable: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Learn from the rows where ``usable`` holds and score all rows."""
    training = docs.where(usable)
    counted = count_words(training, text)
    known = vocabulary(counted)
    return score_texts(docs, counted, known, train(training, known, text), text, key)
