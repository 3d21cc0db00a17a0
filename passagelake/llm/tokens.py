"""Token ids of a public byte-level BPE file, with a cache over its own word pieces."""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: How this kind of tokenizer cuts a text before merging (fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_CACHED = 400_000
#: A space between white space, where runs of it would be cut.
AWKWARD = re.compile(r"\s (?:\s|\Z)|  ").search
#: UTF-8 of texts that are encoded at once, unless one text is longer.
BYTES_AT_ONCE = 8 << 20
#: Bytes that letters' tables of all versions agree on: printed ASCII, the line end, and letters and signs up to U+027F but for U+0080 to U+00BF.
SETTLED = np.isin(np.arange(256), [10, *range(33, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
#: Chunks beyond this many bytes are cut by themselves.
LONG_CHUNK = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a file: itself if it can be printed, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in shown else next(hidden)): b for b in range(256)}


def _end_to_end(texts: pa.Array, between: str) -> pa.Scalar:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(texts)], texts), pa.scalar(between, texts.type))[0]


class ByteBpe:
    """encode(text) gives the ids that the tokenizer gives with add_special_tokens=False.

    Such a tokenizer never merges across the pieces of its pattern, so ids can be kept by piece, and a new piece needs its
    merges only. Where each merge makes the next id, as is usual, tiktoken does those several times as fast from the same
    vocabulary. A text that holds one of the special tokens' strings goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre, model = described["pre_tokenizer"], described["model"]
        vocabulary = model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not described["normalizer"]
        plain = plain and all(vocabulary[m] == i for i, m in enumerate(merged, 256))
        self.special = [t["content"] for t in described["added_tokens"]]
        self.pieces = regex.compile(PIECES).findall if plain else None
        letters = byte_letters()
        self.lengths = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in described["added_tokens"])]), np.int64)
        for word, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in described["added_tokens"])]:
            self.lengths[i] = len(word) if all(c in letters for c in word) else len(word.encode())
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        if plain:
            ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if word not in self.special}
            self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.merge = self.encoding._encode_single_piece

    @functools.cached_property
    def tokenizer(self):
        """Loaded when a text needs it."""
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return Tokenizer.from_file(self.path)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        if self.pieces is None or any(s in text for s in self.special):
            return np.frombuffer(self._ids(text), dtype="<u4")
        if AWKWARD(text):
            return np.frombuffer(self._joined(self.pieces(text)), dtype="<u4")
        first, *rest = text.split(" ")
        return np.frombuffer(self._joined(self.pieces(first)) + self._spaced(rest), dtype="<u4")

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null one has none. BYTES_AT_ONCE are held at once, or the longest text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for start, end in slices(pc.binary_length(texts).to_pylist(), BYTES_AT_ONCE):
            yield from self._encode_some(texts.slice(start, end - start))

    def _encode_some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each distinct chunk between spaces is encoded once; a text's ids are then taken by the numbers of its chunks."""
        if self.pieces is None:
            yield from map(self.encode, texts.to_pylist())
            return
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy() - split.offsets[0].as_py()
        found = split.flatten().dictionary_encode()
        numbers = found.indices.to_numpy().astype(np.int64)
        ids, starts, sizes, spaced = self._chunk_ids(found.dictionary)
        firsts = found.dictionary.take(pa.array(numbers[edges[:-1]])).to_pylist()
        alone = [self._joined(self.pieces(x)) for x in firsts]  # what no space stands before
        of_alone = np.fromiter(map(len, alone), np.int64, len(alone)) // 4
        starts = np.concatenate((starts, len(ids) + np.cumsum(of_alone) - of_alone))
        ids, sizes = np.concatenate((ids, np.frombuffer(b"".join(alone), dtype="<u4"))), np.concatenate((sizes, of_alone))
        apart = spaced[numbers]
        numbers[edges[:-1]], apart[edges[:-1]] = len(spaced) + np.arange(len(alone)), False
        apart = np.logical_or.reduceat(apart, edges[:-1])
        for special in self.special:
            apart |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        sizes = sizes[numbers]
        ends = np.cumsum(sizes)
        all_ids = ids[np.repeat(starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])]
        begin = 0
        for i, end in enumerate(ends[edges[1:] - 1].tolist()):
            yield self.encode(texts[i].as_py()) if apart[i] else all_ids[begin:end]
            begin = end

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where those of each chunk after a space begin among them, how many it has, and which chunks are empty or begin with white space: texts where such a one follows a space may be awkward."""
        lengths = pc.binary_length(chunks).to_numpy()
        data = np.frombuffer(_end_to_end(chunks, "").as_buffer(), np.uint8)
        begins, held = np.cumsum(lengths) - lengths, np.flatnonzero(lengths)
        settled, first = np.zeros(len(lengths), bool), np.zeros(len(lengths), np.uint8)
        if len(held):
            settled[held] = np.logical_and.reduceat(SETTLED[data], begins[held])
            first[held] = data[begins[held]]
            settled[held] &= (first[held] != 10) & (data[begins[held] + lengths[held] - 1] != 10) & (lengths[held] <= LONG_CHUNK)
        odd = np.flatnonzero(~settled)
        texts, spaced = chunks.take(pa.array(odd)).to_pylist(), np.zeros(len(lengths), bool)
        spaced[odd] = [not x or x[0].isspace() for x in texts]
        own = [self._spaced([x]) for x in texts]
        # the others don't begin or end with white space, so that one text of them all is cut between them
        plain = np.flatnonzero(settled)
        together = _end_to_end(chunks.take(pa.array(plain)), " ").as_py()
        ids = self.encoding.encode_to_numpy(f" {together}" if together else "", disallowed_special=()).astype("<u4")
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(lengths[plain] + 1), side="right")
        sizes, starts = np.empty_like(lengths), np.empty_like(lengths)
        sizes[plain], sizes[odd] = np.diff(cuts, prepend=0), np.fromiter(map(len, own), np.int64, len(own)) // 4
        order = np.concatenate((plain, odd))
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate((ids, np.frombuffer(b"".join(own), dtype="<u4"))), starts, sizes, spaced

    def within(self, ids: np.ndarray, size: int) -> int:
        """How many of the first ids lie in the first so many bytes of their text."""
        return int(np.searchsorted(np.cumsum(self.lengths[ids[:size]]), size, side="right"))  # each has a byte at least

    def _joined(self, pieces: list[str]) -> bytes:
        known = self.cache
        if new := set(pieces).difference(known):
            self._bound()
            for p in new if known else set(pieces):
                ids = self.merge(p)
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, pieces))

    def _spaced(self, chunks: list[str]) -> bytes:
        """Ids of chunks that each follow one space. The pattern never takes a space with what stands before it."""
        known = self.chunks
        if new := set(chunks).difference(known):
            self._bound()
            for c in new if known else set(chunks):
                ids = [i for p in self.pieces(f" {c}") for i in self.merge(p)]
                known[c] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(known.__getitem__, chunks))

    def _bound(self) -> None:
        for kept in (self.cache, self.chunks):
            if len(kept) > MOST_CACHED:
                kept.clear()


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each Python worker."""
    return ByteBpe(path)
