"""Numbers that define the operators' semantics."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_target: int = 512
    chunk_overlap: int = 64
    chunk_min: int = 32
    separator: str = " > "
    max_depth: int = 4
    pdf_size_ratio: float = 1.12
    pdf_heading_words: int = 18
    candidates: int = 40
    shortlist: int = 40
    max_terms: int = 40
    rrf_k: int = 60
    vector_weight: float = 1.0
    lexical_weight: float = 0.8
    top_k: int = 6
    per_document: int = 3
    context_chars: int = 12000
    snippet_chars: int = 2000
    history_turns: int = 6
    title_chars: int = 60
    question_chars: int = 4000
    password_chars: int = 10
    password_bytes: int = 72
    max_attempts: int = 3
    backoff_base: int = 30
    backoff_max: int = 900
    stale_seconds: int = 300
    retention_hours: int = 168
    max_documents: int = 100
    max_bytes: int = 500 * 1024 * 1024
    slow_ms: float = 5000.0
    wilson_z: float = 1.96


SETTINGS = Settings()
NO_CONTEXT = "I could not find anything relevant to that in your documents."
