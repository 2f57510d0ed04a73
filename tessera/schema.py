"""Parameters that the operators share. Time is given, never read from a clock."""

from __future__ import annotations

from dataclasses import dataclass

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class RecommendWeights:
    percentile: float = 0.30
    downloads: float = 0.30
    recent: float = 0.10
    trend: float = 0.20
    affinity: float = 0.10


@dataclass(frozen=True)
class TrendConfig:
    window_days: int = 30
    min_interval_ms: int = 6 * HOUR_MS
    max_samples: int = 30
    keep_days: int = 90
    least_span_ms: int = HOUR_MS


@dataclass(frozen=True)
class HealthThresholds:
    healthy_days: int = 120
    aging_days: int = 365


@dataclass(frozen=True)
class MmrConfig:
    relevance: float = 0.75
    size: int = 30
    consecutive: int = 2


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    top: int = 500
