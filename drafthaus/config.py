"""Thresholds of the engine; every function takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    label_distance: float = 350.0
    labels_per_symbol: int = 3
    edge_distance: float = 200.0
    signal_distance: float = 80.0
    line_distance: float = 300.0
    aligned: float = 30.0
    detection_confidence: float = 0.5
    iou: float = 0.45
    ocr_confidence: float = 0.2
    review: float = 0.6
    low: float = 0.5
    tile: int = 1312
    overlap: int = 128
    tile_edge: float = 6.0
    rare_class: int = 20
    retention_hours: float = 24.0


SETTINGS = Settings()
