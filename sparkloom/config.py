"""Every tunable of the document operators, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    chunk_size: int = 600
    chunk_overlap: int = 75
    archive_members: int = 2000
    archive_bytes: int = 256 << 20
    relation_threshold: float = 0.70
    merge_threshold: float = 92.0
    sentence_chars: int = 1000
    graph_limit: int = 150
    top_k: int = 20
    rerank_top_k: int = 5
    rrf_k: int = 60
    context_tokens: int = 2500
    chars_per_token: int = 4
    route_confidence: float = 0.9
    route_complexity: float = 0.7


DEFAULTS = Config()
