"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for a missing vector, unequal sizes or a zero vector."""
    magnitude = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (magnitude > 0)
    return F.when(ok, dot(a, b) / magnitude).otherwise(F.lit(0.0))


def relevance(score: Column) -> Column:
    """Cosine mapped to the range 0..1."""
    return (1 + score) / 2
