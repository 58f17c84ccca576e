"""Dates written as text, against a fixed reference day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlens.functions.text import as_column

AS_OF = dt.date(2026, 6, 14)
UNKNOWN_MONTHS = 999


def months_since(c: Column | str, as_of: dt.date = AS_OF) -> Column:
    """Whole months up to ``as_of``, at least 0; 999 for a missing or invalid date."""
    text = F.coalesce(as_column(c), F.lit(""))
    day = F.when(F.regexp_like(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))
    months = (
        (F.lit(as_of.year) - F.year(day)) * 12 + (F.lit(as_of.month) - F.month(day)) - (F.lit(as_of.day) < F.dayofmonth(day)).cast("int")
    )
    return F.when(day.isNull(), UNKNOWN_MONTHS).otherwise(F.greatest(F.lit(0), months)).cast("int")


def year_month(c: Column | str) -> Column:
    """Months since year 0 of a leading ``yyyy-mm``, or null."""
    text = F.coalesce(as_column(c), F.lit(""))
    year = F.regexp_extract(text, r"^(\d{4})-(\d{2})", 1).try_cast("int")
    return year * 12 + F.regexp_extract(text, r"^(\d{4})-(\d{2})", 2).try_cast("int")


def is_future(c: Column | str, as_of: dt.date = AS_OF) -> Column:
    """The month lies after the reference month (false if there is none)."""
    return F.coalesce(year_month(c) > as_of.year * 12 + as_of.month, F.lit(False))


def date_before(a: Column | str, b: Column | str) -> Column:
    """Both are ``yyyy-mm-dd...`` and a sorts before b."""
    a, b = (F.coalesce(as_column(x), F.lit("")) for x in (a, b))
    dated = lambda x: F.regexp_like(x, F.lit(r"^\d{4}-\d{2}-\d{2}"))
    return dated(a) & dated(b) & (a < b)


def recency(c: Column | str, as_of: dt.date = AS_OF, cap: float = 6.0) -> Column:
    """1 this month down to 0 after ``cap`` months, by month alone; 0.5 without a date."""
    months = F.lit(as_of.year * 12 + as_of.month) - year_month(c)
    return F.when(months.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - months / cap)))


def duration_months(start: Column | str, end: Column | str, as_of: dt.date = AS_OF) -> Column:
    """Months from ``yyyy[-mm]`` to ``yyyy[-mm]``, an open end being now; 0 without a start."""

    def months(c):
        text = F.coalesce(as_column(c), F.lit(""))
        year = F.regexp_extract(text, r"^\s*(\d{4})(?:-(\d{1,2}))?", 1).try_cast("int")
        month = F.coalesce(F.regexp_extract(text, r"^\s*(\d{4})(?:-(\d{1,2}))?", 2).try_cast("int"), F.lit(1))
        return year * 12 + month

    last = F.coalesce(months(end), F.lit(as_of.year * 12 + as_of.month))
    return F.coalesce(F.greatest(F.lit(0), last - months(start)), F.lit(0))
