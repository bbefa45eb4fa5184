"""Vector arithmetic over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has zero length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(diff)


def unit(a: Column, guard: float = 0.0) -> Column:
    """Scaled to length one; a zero vector stays zero. The length is bound once per vector."""
    def scale(size: Column) -> Column:
        return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    return F.element_at(F.transform(F.array(norm(a) + F.lit(guard)), scale), 1)
