"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """The vector over its norm; zeros stay."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine01(a: Column, b: Column) -> Column:
    """0.5 + 0.5 * cosine; 0 when a vector is missing or all zeros."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, 0.5 + 0.5 * dot(a, b) / n), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return norm(subtract(a, b))
