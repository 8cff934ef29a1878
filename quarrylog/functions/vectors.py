"""Vector expressions on array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero or missing vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)
