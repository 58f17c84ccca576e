"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlens.functions.scalars import clamp

COSINE_FLOOR, COSINE_CEILING, ALPHA = 0.12, 0.65, 0.6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = length(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def rescaled_cosine(a: Column, b: Column) -> Column:
    """Cosine stretched from its telling band to [0, 1]; 0 for a zero vector."""
    n = length(a) * length(b)
    cosine = dot(a, b) / F.when(n == 0, F.lit(None)).otherwise(n)
    return F.coalesce(clamp((cosine - COSINE_FLOOR) / (COSINE_CEILING - COSINE_FLOOR)), F.lit(0.0))


def hybrid(dense: Column, lexical: Column, alpha: float = ALPHA) -> Column:
    """alpha parts dense, the rest lexical; lexical alone where there is no vector."""
    return F.when(dense.isNull(), lexical).otherwise(alpha * dense + (1.0 - alpha) * lexical)
