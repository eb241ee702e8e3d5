"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    """Every component is a number that isn't NaN or infinite."""
    return F.coalesce(F.forall(_double(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in [0, 2]; 1 for a zero norm or different lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / size)))


def unit(a: Column) -> Column:
    """The vector at length 1; null if its norm is 0."""
    return F.when(norm(a) > 0, F.transform(_double(a), lambda x: x / norm(a)))
