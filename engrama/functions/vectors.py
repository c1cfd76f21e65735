"""Vector column functions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within [0, 2]; 1 if either vector is zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - cosine_similarity(a, b)))


def blend(a: Column, b: Column, share: float) -> Column:
    """The normalised weighted sum of two vectors, b having `share`."""
    mixed = F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y)
    size = F.sqrt(F.aggregate(mixed, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(mixed, lambda x: x / size)).otherwise(mixed)
