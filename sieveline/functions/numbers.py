"""Number helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, slope: float, middle: float) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - middle)))


def weighted(weights: Mapping[str, float]) -> Column:
    """Sum of columns times their weights."""
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * w
    return out


def or_else(c: Column | str, value) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(value))
