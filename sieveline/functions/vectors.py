"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length; 1 for a zero vector."""
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector, which is normalised here once."""
    size = sum(x * x for x in query) ** 0.5 + 1e-9
    return dot(a, F.array(*(F.lit(float(x) / size) for x in query))) / norm(a)
