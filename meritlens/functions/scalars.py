"""Arithmetic on scores in [0, 1]."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlens.functions import lexicons as lx
from meritlens.functions.text import as_column

GAMMA, QUALITY_FLOOR = 1.1, 0.45
GENERIC = ("seniority", "logistics", "behavioral", "trust")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def rounded(c: Column, digits: int) -> Column:
    """c to ``digits`` places by its scaled value, ties away from zero: what SQL engines round doubles to.

    Spark's own round goes by the shortest decimal that names the double, which tells other ties."""
    scale = float(10**digits)
    return F.round(c * scale) / scale


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, also where f takes it many times or within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def steps(c: Column, *bounds: tuple[float, float], otherwise: float) -> Column:
    """The value of the first bound that c does not exceed."""
    out = None
    for bound, value in bounds:
        out = F.when(c <= bound, value) if out is None else out.when(c <= bound, value)
    return out.otherwise(otherwise)


def fraction(c: Column | str, high: float) -> Column:
    """c / high within [0, 1]; 0 for what is no number."""
    return F.coalesce(clamp(as_column(c).try_cast("double") / high), F.lit(0.0))


def falling(c: Column | str, cap: float) -> Column:
    """1 at 0 down to 0 at ``cap``; 0 for what is no number."""
    return F.coalesce(clamp(1.0 - as_column(c).try_cast("double") / cap), F.lit(0.0))


def notice(c: Column | str) -> Column:
    """Credit for a short notice period in days; 0.5 for what is no number."""
    days = as_column(c).try_cast("double")
    return F.when(days.isNull(), 0.5).otherwise(steps(days, (30, 1.0), (60, 0.7), (90, 0.35), otherwise=0.15))


def recency_factor(months: Column) -> Column:
    return steps(months, (1, 1.0), (3, 0.75), (6, 0.35), otherwise=0.1)


def open_term(flag: Column, months: Column) -> Column:
    """Availability by the open-to-work flag, trusted as far as the profile is fresh; 0.55 if unset."""
    fresh = recency_factor(months)
    return F.when(flag.isNull(), 0.55).when(flag, 0.55 + 0.45 * fresh).otherwise(0.55 - 0.20 * fresh)


def seniority(years: Column, preferred: tuple[float, float], strongest: tuple[float, float]) -> Column:
    near = ((years >= 4) & (years < preferred[0])) | ((years > preferred[1]) & (years <= 11))
    return (
        F.when(years.between(*strongest), 1.0).when(years.between(*preferred), 0.88).when(near, 0.62).otherwise(0.25)
    )


def quality(parts: Mapping[str, Column], weights: Mapping[str, float | Column], total: Column | None = None) -> Column:
    """Weighted mean of the generic factors over their own weights (whose ``total`` is given if they are columns)."""
    total = (sum(weights.get(k, 0.0) for k in GENERIC) or 1.0) if total is None else total
    return clamp(sum((F.lit(weights.get(k, 0.0)) * parts[k] for k in GENERIC), F.lit(0.0)) / total)


def gate(relevance: Column, quality_: Column, soft: Column | None = None, keep: Column | None = None) -> Column:
    """The scoring law: relevance to a power times floored quality, soft penalty and veto."""
    base = clamp(F.pow(clamp(relevance), F.lit(GAMMA)) * (QUALITY_FLOOR + (1.0 - QUALITY_FLOOR) * clamp(quality_)))
    if soft is not None:
        base = base * clamp(soft)
    return base if keep is None else F.when(keep, base).otherwise(0.0)


def reachability(months: Column, rate: Column, flag: Column) -> Column:
    """struct(label, score): observed activity first, the flag second; unknown without either."""
    active = (months < 999) | (rate > 0)
    score = rounded(clamp(0.45 * recency_factor(months) + 0.35 * rate + 0.20 * open_term(flag, months)), 3)
    seen = (months <= 3) | (rate >= 0.4)
    is_open, closed = F.coalesce(flag, F.lit(False)), F.coalesce(~flag, F.lit(False))
    label = (
        F.when(~active & is_open, "reachable").when(~active, "unknown")
        .when(seen & closed, "passive").when(seen, "reachable")
        .when((months >= 6) | (rate < 0.15), "stale").otherwise("passive")
    )
    return F.struct(
        label.alias("label"), F.when(~active & is_open, 0.6).when(~active, 0.5).otherwise(score).alias("score")
    )


def blended(values: list[tuple[Column, float]]) -> Column:
    """Weighted mean of signal scores; a total weight of 0 counts as 1."""
    total = sum(w for _, w in values) or 1.0
    return sum((c * w for c, w in values), F.lit(0.0)) / total


def hireability(availability: Column, engagement: Column, trust: Column) -> Column:
    return rounded(0.40 * availability + 0.35 * engagement + 0.25 * trust, 4)


def account_activity(repos: Column, stars: Column, followers: Column, active: Column) -> Column:
    """Activity score of a code-hosting account from log counts."""
    part = lambda c, full: F.least(F.lit(1.0), F.log1p(c) / F.log1p(F.lit(float(full))))
    recent = F.when(active, 1.0).otherwise(0.4)
    return rounded(0.35 * part(repos, 40) + 0.35 * part(stars, 500) + 0.15 * part(followers, 300) + 0.15 * recent, 3)


def risk_penalty(flags: Column) -> Column:
    """Summed penalties of risk flags, at most 0.45."""
    table = F.create_map(*(F.lit(x) for item in lx.RISK_PENALTIES.items() for x in item))
    return F.least(
        F.lit(0.45),
        F.aggregate(flags, F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(lx.UNKNOWN_RISK_PENALTY))),
    )


def present(*conditions: tuple[Column, str]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, name) for c, name in conditions)))


def min_max(c: Column, over) -> Column:
    """c scaled to [0, 1] over a window; a span of 0 counts as 1."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return (c - low) / F.when(high > low, high - low).otherwise(1.0)
