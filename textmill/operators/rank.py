"""BM25F: constants and formulas, as numbers and as columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH, TITLE, BODY = 0, 1, 2
FIELD_NAMES = ("path", "title", "body")


@dataclass(frozen=True)
class Params:
    """Saturation, and by field (path, title, body) the weight and the length normalisation."""

    k1: float = 1.2
    weight: tuple[float, float, float] = (2.0, 3.0, 1.0)
    b: tuple[float, float, float] = (0.5, 0.5, 0.75)


@dataclass(frozen=True)
class Recency:
    """Score multiplier 1 + rate * 0.5 ** (age in days / half-life)."""

    rate: float
    half_life_days: float
    now: int

    @property
    def on(self) -> bool:
        return self.rate > 0 and self.half_life_days > 0

    def boost(self, mtime: Column) -> Column:
        days = (F.lit(float(self.now)) - mtime) / 86400.0
        return F.lit(1.0) + self.rate * F.pow(F.lit(0.5), days / float(self.half_life_days)) if self.on else F.lit(1.0)


@dataclass(frozen=True)
class Stats:
    """All documents, deleted ones too until they are compacted; by field, documents that have tokens and their tokens."""

    n: int
    doc_count: tuple[int, int, int]
    total_len: tuple[int, int, int]

    def average(self, f: int) -> float:
        return self.total_len[f] / self.doc_count[f] if self.doc_count[f] else 0.0


def idf(n: int, df: int) -> float:
    return math.log1p((n - df + 0.5) / (df + 0.5)) if df else 0.0


def field_weight(params: Params, stats: Stats, of: Column, tf: Column, length: Column) -> Column:
    """A posting's share of the term's weighted frequency."""
    out = F.lit(0.0)
    for f in range(3):
        average = stats.average(f)
        norm = F.lit(1 - params.b[f]) + params.b[f] * length / average if average else F.lit(1.0)
        out = F.when(of == f, params.weight[f] * tf / F.when(norm > 0, norm).otherwise(1e-9)).otherwise(out)
    return out
