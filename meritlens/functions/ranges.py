"""Ranges of an ordered column: fixed bounds from a sample, and the range a value falls into."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def value_bounds(rows: DataFrame, column: str, ranges: int, distinct: int) -> list[Any]:
    """At most ``ranges`` - 1 ascending values that cut the column's different values, ``distinct`` in all, into
    ranges of like number; a frequent value counts once.

    They come from about SAMPLE values, chosen by a hash: the same rows give the same bounds.  Bounds only deal
    work out; no result depends on them."""
    step = max(1, distinct // SAMPLE)
    picked = rows.select(column).where(F.pmod(F.xxhash64(column), F.lit(step)) == 0).distinct().limit(4 * SAMPLE).collect()
    found = sorted(r[0] for r in picked)
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def range_of(value: Column, bounds: Sequence[Any], kind: str) -> Column:
    """Number of bounds at or below ``value``, by a search on two levels; null falls into range 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda b: (F.struct(*map(F.lit, b)) if isinstance(b, tuple) else F.lit(b)).cast(kind)
    heads = F.array(*(literal(g[0]) for g in groups))
    listed = F.array(*(F.array(*map(literal, g)) for g in groups))
    group = F.size(F.filter(heads, lambda b: b <= value))
    inside = F.size(F.filter(F.get(listed, group - 1), lambda b: b <= value))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * step + inside)


def order_of(score: str, key: str) -> Column:
    """A struct that ascends as rows by (score desc, key) do; a null score comes last."""
    return F.struct(F.col(score).isNull().alias("none"), (-F.coalesce(F.col(score), F.lit(0))).alias("low"), F.col(key).alias("key"))


def order_bounds(rows: DataFrame, score: str, key: str, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 values of :func:`order_of` that cut the rows into ranges of like size.

    A score that most rows have is cut by its keys.  Rows are picked by a hash of the key, so that scores are worked
    out for about SAMPLE rows only; bounds only deal work out."""
    step = max(1, rows.select(key).count() // SAMPLE)
    picked = rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).select(order_of(score, key).alias("o"))
    found = sorted(tuple(r.o) for r in picked.limit(4 * SAMPLE).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []
