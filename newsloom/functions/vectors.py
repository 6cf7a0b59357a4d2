"""[G28] Vector expressions over arrays of numbers, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """The length is bound once; within the inner lambda it would be summed for each element."""
    return F.get(F.transform(F.array(F.nullif(norm(a), F.lit(0.0))), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))
