"""Signals of any vocabulary as availability, engagement and trust; a registry of further signals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import dates as dt
from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc


def _scaled(name: Column, value: Column) -> Column:
    """struct(rule, dimension, score) of the first rule whose pattern fits the field's name, or null."""
    low = F.lower(name)
    flag = F.when(F.lower(value).isin("false", "", "0", "0.0", "{}", "[]"), 0.0).otherwise(1.0)
    recency = F.when(F.contains(low, F.lit("day")), sc.falling(value, 180.0)).otherwise(dt.recency(value))
    kinds = {"flag": flag, "notice": sc.notice(value), "recency": recency, "hours": sc.falling(value, 240.0)}
    out = None
    for rule, (pattern, dimension, kind) in enumerate(lx.SIGNAL_RULES):
        score = kinds[kind] if isinstance(kind, str) else sc.fraction(value, kind)
        pair = F.struct(F.lit(rule).alias("rule"), F.lit(dimension).alias("dimension"), score.cast("double").alias("score"))
        fits = F.regexp_like(low, F.lit(pattern))
        out = F.when(fits, pair) if out is None else out.when(fits, pair)
    return out


def schema_signals(signals: Column | str = "signals") -> Column:
    """struct(availability, engagement, trust): the mean of each dimension's fields, 0.5 without any.

    Fields are added up in the order of rules, whatever their order in the map."""
    entries = F.map_entries(F.col(signals) if isinstance(signals, str) else signals)
    rated = F.array_sort(F.array_compact(F.transform(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), lambda e: _scaled(e["key"], e["value"]))))

    def mean(dimension: str) -> Column:
        own = F.filter(rated, lambda r: r["dimension"] == dimension)
        total = F.aggregate(own, F.lit(0.0), lambda a, r: a + r["score"])
        return F.when(F.size(own) > 0, sc.rounded(total / F.size(own), 4)).otherwise(0.5).alias(dimension)

    return F.struct(mean("availability"), mean("engagement"), mean("trust"))


@dataclass(frozen=True)
class Signal:
    """A named score column with a weight; ``applies`` says for which rows it counts."""

    name: str
    weight: float
    score: Callable[[], Column]
    applies: Callable[[], Column] = lambda: F.lit(True)


REGISTRY: dict[str, Signal] = {}


def register(signal: Signal) -> Signal:
    REGISTRY[signal.name] = signal
    return signal


def blend(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each registered signal and ``blended``, their weighted mean, summed as registered.

    A score that is null or not finite counts as 0, so that one signal cannot break a row."""
    chosen = [REGISTRY[n] for n in (names or REGISTRY)]
    safe = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    scored = df.withColumns({f"signal_{s.name}": safe(s.score()) for s in chosen})
    weight = sum((F.when(s.applies(), s.weight).otherwise(0.0) for s in chosen), F.lit(0.0))
    total = sum((F.when(s.applies(), s.weight).otherwise(0.0) * F.col(f"signal_{s.name}") for s in chosen), F.lit(0.0))
    return scored.withColumn("blended", total / F.when(weight == 0, 1.0).otherwise(weight))


register(Signal("hireability", 1.0, lambda: sc.hireability(*(F.col(f"schema_signals.{d}") for d in ("availability", "engagement", "trust")))))
register(Signal("consistency", 1.0, lambda: F.when(F.col("impossible"), 0.0).otherwise(1.0 - F.col("audit_penalty"))))
register(Signal("account_activity", 0.5, lambda: sc.fraction(F.col("github_activity_score"), 100.0), lambda: F.col("github_activity_score") >= 0))
register(Signal("background_verification", 0.0, lambda: F.lit(0.0)))
register(Signal("repository_analysis", 0.0, lambda: F.lit(0.0)))
