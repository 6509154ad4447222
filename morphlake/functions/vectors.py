"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at length one; null if it is null or empty, its length is zero or a component is not finite."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(x, lambda e: e / norm))


def clamped_dot(a: Column, b: Column) -> Column:
    """Cosine of normalized vectors, from -1 to 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
