"""Scores, similarities and nearest-rank percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x: Column | str, a: float = 1.0, b: float = 0.0) -> Column:
    """1 / (1 + exp(-(a x + b))), without overflow."""
    z = _c(x) * F.lit(a) + F.lit(b)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def dot(x: Column | str, y: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column | str, y: Column | str) -> Column:
    """Cosine in double precision; null for a zero norm."""
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def band(confidence: Column | str, threshold: float = 0.30, floor: float = 0.15) -> Column:
    """confident at the threshold or above, low_confidence at the floor or above, else insufficient (also for null)."""
    c = _c(confidence)
    return F.when(c >= threshold, "confident").when(c >= floor, "low_confidence").otherwise("insufficient")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full periods of 24 hours between two timestamps."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000))
