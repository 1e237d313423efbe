"""Vector arithmetic on array<float> / array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector has zero length."""
    product = norm(a) * norm(b)
    return F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / product)


def unit(a: Column) -> Column:
    """x / |x|; a zero vector is left as it is."""
    length = norm(a)
    return F.transform(a, lambda v: F.when(length == 0, v.cast("double")).otherwise(v.cast("double") / length))
