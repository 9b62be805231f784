"""Fixed values of search and ingestion."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    rrf_k: int = 60
    chunk_multiplier: int = 4
    book_multiplier: int = 3
    sorted_multiplier: int = 4
    chunks_per_book: int = 10
    drop_ratio: float = 0.2
    chunk_tokens: tuple[int, int] = (128, 1024)
    section_tokens: tuple[int, int] = (800, 5000)
    chunk_bytes: int = 15500
    window: int = 3
    percentile: float = 25
    context_budget: int = 100_000
    context_reach: int = 2
    high_water: int = 32
    max_attempts: int = 3
    stale_seconds: int = 14_400
    stages: tuple[str, ...] = ("extract", "summarize", "embed_index", "finalize")
    stage_seconds: dict[str, int] = field(default_factory=lambda: {"extract": 1800, "summarize": 1200, "embed_index": 1200, "finalize": 900})
    #: The stages left after each checkpoint; an unknown checkpoint means all.
    remaining: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"pending": ("extract", "summarize", "embed_index", "finalize"), "extracted": ("summarize", "embed_index", "finalize"), "summarized": ("embed_index", "finalize"), "indexed": ("finalize",), "finalized": ()})
    history: int = 20
    summary_chars: int = 14_000


CONFIG = Config()
