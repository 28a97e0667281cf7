"""Settings of the engine. Sizes are in tokens unless a name says otherwise."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """``strict`` keeps known quirks of ingestion and context building; without it they are mended (see README)."""

    chunk_target: int = 400
    chunk_max: int = 512
    chunk_min: int = 50
    chunk_overlap: int = 50
    min_quality: float = 0.45
    default_language: str = "as"
    dense_top_k: int = 20
    bm25_top_k: int = 20
    rrf_top_k: int = 20
    rrf_k: int = 60
    mmr_top_k: int = 20
    mmr_lambda: float = 0.7
    rerank_input: int = 20
    rerank_top_k: int = 5
    context_tokens: int = 3000
    memory_turns: int = 6
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    embedding_dim: int = 1024
    embedding_batch: int = 8
    ocr_threshold: float = 0.60
    ocr_language_indic: str = "devanagari"
    ocr_language_latin: str = "en"
    max_upload_bytes: int = 50 * 1024 * 1024
    strict: bool = True


DEFAULT = EngineConfig()


def or_default(value: int | None, default: int) -> int:
    """0 and None both mean the default."""
    return value or default
