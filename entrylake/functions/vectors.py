"""Vector expressions over array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(_total(F.transform(diff, lambda d: d * d)))


def vector_problem(v: Column, dim: int) -> Column:
    """Why a vector cannot be searched: null, width, element, zero; null if it can."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0.0)
    return (F.when(v.isNull(), "null").when(F.size(v) != dim, "width")
            .when(bad, "element").when(zero, "zero"))
