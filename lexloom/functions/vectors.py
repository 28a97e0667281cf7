"""Functions on vectors held as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.transform(_doubles(a), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d != 0, dot(a, b) / d)


def mean_pool(rows: Column) -> Column:
    """The mean of an array of vectors of one length, L2-normalised; null for no vectors."""
    total = F.aggregate(F.slice(rows, 2, F.size(rows)), F.element_at(rows, 1).cast("array<double>"), lambda s, r: F.zip_with(s, r.cast("array<double>"), lambda x, y: x + y))
    return F.when(F.size(rows) > 0, l2_normalize(F.transform(total, lambda x: x / F.size(rows))))
