"""Distances and shares of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def angular_distance(a: Column, b: Column) -> Column:
    """Angle over pi; 0 for a zero vector."""
    cosine = 1 - cosine_distance(a, b)
    return F.when(cosine.isNull(), 0.0).otherwise(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))) / F.pi())


def half_chord(a: Column, b: Column) -> Column:
    """sqrt((1 - cosine) / 2)."""
    return F.sqrt(cosine_distance(a, b) / 2)


def hard_cluster(v: Column) -> Column:
    """The place (from 0) of the first largest entry."""
    return F.array_position(v, F.array_max(v)) - 1


def shares(v: Column) -> Column:
    total = _total(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), total))


def softmax(v: Column) -> Column:
    top = F.array_max(v).cast("double")
    raised = F.transform(v, lambda x: F.exp(x.cast("double") - top))
    total = _total(raised)
    return F.transform(raised, lambda x: x / total)


def positive_part(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + 0.0


def negative_part(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0)) + 0.0  # no negative zero
