"""Vector arithmetic as Column expressions, for pairs that already share a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""

    def term(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, term))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
