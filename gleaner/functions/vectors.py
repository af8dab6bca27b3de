"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
        )
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)``; null when either vector has no direction."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity(distance: Column) -> Column:
    """``max(0, 1 - distance)``, a missing distance counting as 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(distance, F.lit(1.0)))
