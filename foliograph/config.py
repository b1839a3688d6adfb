"""Tunables in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    text_dim: int = 384
    image_dim: int = 512
    chunk_size: int = 500
    chunk_overlap: int = 50
    min_image_px: int = 50
    min_table_rows: int = 2
    ocr_threshold: int = 30
    region_min_pt: float = 60.0
    region_max_share: float = 0.85
    regions_per_page: int = 5
    candidates: int = 30
    results: int = 20
    summary_sentences: int = 5
    graph_threshold: float = 0.35
    graph_max_edges: int = 4
    chunks_per_document: int = 200
    merge_similarity: float = 0.92
    merge_group: tuple[int, int] = (2, 400)
    cooccurrence_least: int = 2
    cooccurrence_most: int = 500
