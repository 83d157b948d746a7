"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v over its norm; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of vectors of one length, normalized."""
    n = F.size(vectors)
    total = F.aggregate(F.slice(vectors, 2, F.greatest(n - 1, F.lit(0))), doubles(F.element_at(vectors, 1)), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return normalize(F.transform(total, lambda x: x / n))
