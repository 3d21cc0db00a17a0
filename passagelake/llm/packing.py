"""Vector bin packing of training examples.

An example is a vector: its tokens, its segments, and its tokens that bear loss. A sequence limits
all three at once. Of the open sequences that can take an example, the one whose free room has the largest
dot product with the example's demand (both as shares of the limits) takes it, so an example that needs much of one
resource goes where that resource is plentiful.

In documents, the first of several lines is the prompt: its ids bear no loss, nor does the closing id. A sequence that has all the loss it may
bear but not all its tokens waits for ids without loss, which prompts bring.

Each task packs the rows it reads; it holds a fixed number of open sequences, so memory is bounded, nothing
is shuffled, and a lost task is packed again alike.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_bpe

#: Open sequences, and those that wait for ids without loss, at most.
OPEN, WAITING = 24, 256
TOKENS, SEGMENTS, LOSS = 1024, 64, 992


@dataclass
class Piece:
    """Some ids of a document: first ``lead`` without loss, then ``loss`` with, then the others without."""

    key: object
    start: int
    ids: np.ndarray | None
    tokens: int
    segments: int
    lead: int
    loss: int
    whole: int

    def head_loss(self, n: int) -> int:
        return min(max(n - self.lead, 0), self.loss)

    def head(self, tokens: float, loss: float) -> int:
        """How many of the first ids fit in so much room."""
        return int(min(self.tokens, tokens) if self.head_loss(int(tokens)) <= loss else self.lead + loss)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first n ids and the rest."""
        lead, loss = min(n, self.lead), self.head_loss(n)
        return (
            Piece(self.key, self.start, self.ids[:n], n, self.segments, lead, loss, self.whole),
            Piece(self.key, self.start + n, self.ids[n:], self.tokens - n, self.segments, self.lead - lead, self.loss - loss, self.whole),
        )

    def demand(self) -> np.ndarray:
        return np.array((self.tokens, self.segments, self.loss), dtype=np.float64)


@dataclass
class Bins:
    """Open sequences. closed() gives those that are done, as lists of pieces."""

    limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)
    most: int = OPEN
    cutting: bool = True
    done: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if min(self.limits) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array(self.limits, dtype=np.float64)
        self.per_square = 1 / self.limit**2
        #: By place; one that isn't in use has no room.
        self.free = np.full((self.most, 3), -1.0)
        self.held: list[list[Piece]] = [[] for _ in range(self.most)]
        #: Sequences without room for loss: the room for tokens, and the pieces.
        self.waiting: deque[tuple[int, list[Piece]]] = deque()

    def add(self, piece: Piece) -> None:
        if not self.cutting:
            self._place_whole(piece)
            return
        while piece.tokens:
            if piece.lead and self.waiting:
                room, pieces = self.waiting.popleft()
                head, piece = piece.cut(min(room, piece.lead))
                self._wait(room - head.tokens, [*pieces, head])
            elif piece.tokens >= self.limits[0] or piece.loss > self.limits[2]:
                n = piece.head(self.limits[0], self.limits[2])
                if n < self.limits[0] and len(self.waiting) == WAITING:  # a power of two needs no padding
                    head, piece = piece.cut(1 << (n.bit_length() - 1))
                    self.done.append([head])
                else:
                    head, piece = piece.cut(n)
                    self._wait(self.limits[0] - n, [head])
            elif self._fit(piece) or self._open(piece):
                return
            else:
                room, loss = self.free[:, 0], self.free[:, 2]
                heads = np.where(np.clip(room - piece.lead, 0, piece.loss) <= loss, np.minimum(room, piece.tokens), piece.lead + loss)
                k = int(np.where(heads >= 1, room, np.inf).argmin())  # the fullest that takes any
                if heads[k] >= 1:
                    head, piece = piece.cut(int(heads[k]))
                    self._put(k, head)
                else:
                    self._close(int(room.argmin()))

    def _place_whole(self, piece: Piece) -> None:
        if (piece.demand() > self.limit).any():  # it can't share a sequence
            self.done.append([piece])
        elif not (self._fit(piece) or self._open(piece)):
            self._close(int(self.free[:, 0].argmin()))
            self._open(piece)

    def _fit(self, piece: Piece) -> bool:
        demand = np.array((piece.tokens, piece.segments, piece.loss), dtype=np.float64)
        score = np.where((self.free >= demand).all(axis=1), self.free @ (demand * self.per_square), -1.0)
        k = int(score.argmax())
        if score[k] < 0:
            return False
        self._put(k, piece)
        return True

    def _open(self, piece: Piece) -> bool:
        """Puts the piece in a place that isn't in use, if there is one."""
        k = int(self.free[:, 0].argmin())
        if self.free[k, 0] >= 0:
            return False
        self.free[k] = self.limit
        self._put(k, piece)
        return True

    def _put(self, k: int, piece: Piece) -> None:
        self.held[k].append(piece)
        free = self.free[k]
        free -= (piece.tokens, piece.segments, piece.loss)
        tokens, segments, loss = free.tolist()
        if tokens < 1 or segments < 1 or (loss < 1 and not self.cutting):
            self._close(k)
        elif loss < 1:
            self._wait(int(tokens), self._taken(k))

    def _wait(self, room: int, pieces: list[Piece]) -> None:
        """A sequence that lacks ``room`` tokens and can't take more loss."""
        if not room or len(pieces) >= self.limits[1]:
            self.done.append(pieces)
            return
        self.waiting.appendleft((room, pieces)) if len(pieces) > 1 else self.waiting.append((room, pieces))
        if len(self.waiting) > WAITING:
            self.done.append(self.waiting.popleft()[1])

    def _taken(self, k: int) -> list[Piece]:
        pieces, self.held[k], self.free[k] = self.held[k], [], -1.0
        return pieces

    def _close(self, k: int) -> None:
        self.done.append(self._taken(k))

    def finish(self) -> None:
        """Close what is open. Where cutting is allowed, pieces are put together anew: full sequences first, then powers of two, which need no padding."""
        if not self.cutting:
            for k in range(self.most):
                if self.held[k]:
                    self._close(k)
            return
        left = [p for pieces in [*self.held, *(pieces for _, pieces in self.waiting)] for p in pieces]
        self.__post_init__()
        largest = self.limits[0]
        while total := sum(p.tokens for p in left):
            size = min(largest, 1 << (total.bit_length() - 1)) if total < self.limits[0] or largest < self.limits[0] else self.limits[0]
            made, rest = self._filled(left, size)
            if sum(p.tokens for p in made) < size and len(made) < self.limits[1]:  # no more loss fits in: a smaller one, of which loss may be all
                largest = 1 << (min(size - 1, self.limits[2]).bit_length() - 1)
                continue
            self.done.append(made)
            left = rest

    def _filled(self, left: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
        """A sequence of that size as far as it can be filled, and the pieces left: by dot product those that fit whole, then a cut one."""
        limit = np.array((size, self.limits[1], self.limits[2]), dtype=np.float64)
        free, left, made = limit.copy(), list(left), []
        demands = np.array([p.demand() for p in left])
        while left and free[0] >= 1 and free[1] >= 1:
            fits = (demands <= free).all(axis=1)
            if fits.any():
                k = int(np.where(fits, (demands / limit) @ (free / limit), -1.0).argmax())
                piece = left.pop(k)
                demands = np.delete(demands, k, axis=0)
            else:
                heads = [p.head(free[0], free[2]) for p in left]
                k = int(np.argmax(heads))
                if not heads[k]:
                    break
                piece, left[k] = left[k].cut(heads[k])
                demands[k] = left[k].demand()
            made.append(piece)
            free -= piece.demand()
        return made, left

    def closed(self) -> list[list[Piece]]:
        out, self.done = self.done, []
        return out


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    A document's ids are its text's, then one id 0. The closing id bears no loss, nor do as many ids as the first of several lines has. Documents may be cut anywhere; each
    id lies in one piece. No sequence exceeds a limit. A null or empty text is the closing id alone. Repeated rows and null keys are
    packed as rows of their own. Empty input gives an empty result. A sequence is shorter than the token limit only if its
    length is a power of two, its segments ran out, or WAITING others wait too for ids without loss.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins, kinds = byte_bpe(tokenizer), Bins(limits), None
        next_id = TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            nonlocal next_id
            out: list[tuple] = []
            for pieces in bins.closed():
                offset = 0
                for p in pieces:
                    out.append((p.key, p.start, p.tokens, zlib.crc32(p.ids), p.whole, next_id, offset, p.loss))
                    offset += p.tokens
                next_id += 1
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            kinds = batch.schema.field(0).type
            line_ends = pc.find_substring(batch.column(1), "\n")  # in bytes
            for doc, line_end, ids in zip(batch.column(0).to_pylist(), line_ends.to_pylist(), bpe.encode_all(batch.column(1))):
                lead = bpe.within(ids, line_end) if line_end and line_end > 0 else 0
                ids = np.append(ids, np.uint32(0)).astype("<u4")
                bins.add(Piece(doc, 0, ids, len(ids), 1, lead, len(ids) - 1 - lead, len(ids)))
                if len(bins.done) >= 4096:
                    yield rows()
            yield rows()
        if kinds is not None:
            bins.finish()
            yield rows()

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def pack_vectors(examples: DataFrame, key: str = "key", limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Pack whole examples given as columns key, tokens, segments and loss: adds sequence_id and offset.

    Nothing is cut. An example beyond a limit has a sequence of its own. Null numbers count as 0.
    """
    kind = examples.schema[key].dataType.simpleString()
    names = [key, "tokens", "segments", "loss", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, kinds = Bins(limits, cutting=False), None
        next_id = TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            nonlocal next_id
            out: list[list] = [[] for _ in names]
            for pieces in bins.closed():
                offset = 0
                for p in pieces:
                    for column, x in zip(out, (p.key, p.tokens, p.segments, p.loss, next_id, offset)):
                        column.append(x)
                    offset += p.tokens
                next_id += 1
            return pa.RecordBatch.from_arrays([pa.array(out[0], kinds), *(pa.array(c, pa.int64()) for c in out[1:])], names=names)

        for batch in batches:
            kinds = batch.schema.field(0).type
            for k, t, s, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                bins.add(Piece(k, 0, None, t, s, 0, x, t))
            yield rows()
        if kinds is not None:
            bins.finish()
            yield rows()

    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in names[1:4]]
    return examples.select(F.col(key), *numbers).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def conversation_vectors(turns: DataFrame, tokenizer: str) -> DataFrame:
    """A vector for each conversation: all tokens, one segment a turn, and the assistant's tokens as those that bear loss.

    Each turn has a closing id. Null and empty texts are that id alone; a null role bears no loss; turns without conv_id are one conversation. Empty input gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            n = [len(ids) + 1 for ids in bpe.encode_all(batch.column(2))]
            loss = [k if r == "assistant" else 0 for k, r in zip(n, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["key", "tokens", "loss"])

    counted = turns.select("conv_id", "role", "text").mapInArrow(count, "key bigint, tokens bigint, loss bigint")
    return counted.groupBy("key").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss").alias("loss"))
