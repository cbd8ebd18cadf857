"""Defaults of the engine's parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1200
    chunk_overlap: int = 200
    chunk_max_tokens: int = 1200
    embedding_max_tokens: int = 8000
    embedding_batch: int = 100
    context_max_tokens: int = 8000
    answer_max_tokens: int = 2000
    top_k: int = 10
    point_top_k: int = 15
    vector_weight: float = 0.7
    lexical_weight: float = 0.3
    reranking: bool = False
    ocr: bool = False
    cloud_ocr: bool = False
    cloud_ready: bool = False
    cloud: str | None = None
    image_captions: bool = True
    max_images: int = 20
    preserve_tables: bool = True
    coverage_threshold: float = 0.5
    strict_parity: bool = False

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < min(self.chunk_size, self.chunk_max_tokens):
            raise ValueError("the overlap must be under the size of a chunk")

    @property
    def cloud_available(self) -> bool:
        return self.ocr and self.cloud_ocr and self.cloud_ready


DEFAULTS = Settings()
