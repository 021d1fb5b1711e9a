"""Vector functions as Column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 where either vector is zero."""
    d = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), d), F.lit(0.0))


def pair_feature(a: Column, b: Column) -> Column:
    """[a*b, |a-b|, (a-b)^2, cosine]: 3 d + 1 numbers."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    return F.concat(
        F.zip_with(x, y, lambda p, q: p * q), F.zip_with(x, y, lambda p, q: F.abs(p - q)),
        F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.array(cosine_similarity(x, y)),
    )
