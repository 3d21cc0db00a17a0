"""Seams for models: embedding, scoring of pairs, and generation, as vectorised functions over columns.

A factory makes the model once in each task, so that weights load where they are used. The offline models here are deterministic stand-ins
for tests; their results say nothing of a real model's quality.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the asymmetric embedding model wants before a query (fixed value); passages go without.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
BATCH = 32


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, question: str, passages: list[str]) -> list[float]: ...


class Generator(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashingEmbedder:
    """A stand-in: counts of hashed words, of unit length."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class OverlapScorer:
    """A stand-in: the share of the question's words in the passage."""

    def score(self, question: str, passages: list[str]) -> list[float]:
        asked = set(re.findall(r"[a-z0-9]+", question.lower()))
        return [len(asked & set(re.findall(r"[a-z0-9]+", p.lower()))) / max(len(asked), 1) for p in passages]


class ExtractiveGenerator:
    """A stand-in: the first sentence of the first source, cited; where no sentence ends, that source's text."""

    def complete(self, prompt: str) -> str:
        found = re.search(r"\[1\] [^\n]*\n(.*?[.!?])(?:\s|$)", prompt, re.S) or re.search(r"\[1\] [^\n]*\n(.*?)(?:\n\n|$)", prompt, re.S)
        return f"{found[1].strip()} [1]".strip() if found else ""


def embed(text: Column, make: Callable[[], Embedder], query: bool = False) -> Column:
    """Vectors of texts; null and blank texts have none. A vector of another size than the model says fails the job."""
    prefix = QUERY_PREFIX if query else ""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            out: list = [None] * len(texts)
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            for at in range(0, len(some), BATCH):
                rows = some[at : at + BATCH]
                vectors = model.encode([prefix + texts.iloc[i] for i in rows])
                if vectors.shape != (len(rows), model.dim):
                    raise ValueError(f"the model gave vectors of shape {vectors.shape}, not of size {model.dim}")
                for i, v in zip(rows, vectors):
                    out[i] = v
            yield pd.Series(out)

    return run(text)


def score_pairs(question: Column, passage: Column, make: Callable[[], PairScorer]) -> Column:
    """Scores of (question, passage) pairs; questions that follow each other are scored together."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, passages in batches:
            out = np.zeros(len(questions))
            for q, at in questions.fillna("").groupby(questions.fillna(""), sort=False).indices.items():
                out[at] = model.score(q, passages.iloc[at].fillna("").tolist())
            yield pd.Series(out)

    return run(question, passage)


def complete(prompt: Column, make: Callable[[], Generator]) -> Column:
    """Answers to prompts. An empty answer fails the job, as it would be stored as one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            answers = [model.complete(p) if p else None for p in prompts]
            if any(p and not (a and a.strip()) for p, a in zip(prompts, answers)):
                raise ValueError("the model gave an empty answer")
            yield pd.Series(answers)

    return run(prompt)
