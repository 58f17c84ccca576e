"""Dataset profiles: most common values, nearest-rank percentiles, archetypes, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.functions.ranges import range_of, value_bounds
from meritlens.operators.audits import risk_flags


#: Different values that one task counts at most, about, when a percentile is looked for.
MOST_VALUES = 1 << 17


def sums_in_order(rows: DataFrame, by: str, order: str, sums: Mapping[str, Column], first: Mapping[str, Column] | None = None) -> DataFrame:
    """(by, sums.., first..) of each key; doubles are added one by one in the order of ``order``.

    Sums of partial sums have other last digits with every layout of the table.  The sums run along a window, which holds
    no group whole, and the last of them stay.  ``first`` are aggregates that no order moves."""
    along = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumns({**{k: F.sum(c).over(along) for k, c in sums.items()}, "_at": F.count("*").over(along)})
    return running.groupBy(by).agg(*(F.max_by(k, "_at").alias(k) for k in sums), *(c.alias(k) for k, c in (first or {}).items()))


def most_common(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values (the smaller of equals first)."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column)).limit(k)


def narrowed(values: DataFrame, shares: Sequence[float], ranges: int = 256, most: int = MOST_VALUES) -> dict[float, tuple]:
    """{share: (low, high, place)}: a range of ``value`` that holds the place asked for, counted from the range's start.

    Each round counts the pieces of the ranges that still have over ``most`` different values (by an estimate);
    a value that most rows have is one value.  At most ``ranges`` counts for each share reach the driver at once."""
    n, distinct = values.agg(F.count("*"), F.approx_count_distinct("value")).first()
    kind = values.schema["value"].dataType.simpleString()
    held = {float(s): (None, None, min(n - 1, int(n * s)), distinct) for s in shares} if n else {}
    while large := {(low, high, different) for low, high, _, different in held.values() if different > most}:
        pieces = {}
        for low, high, different in large:
            own = values.where(_inside(low, high, kind))
            cuts = value_bounds(own, "value", ranges, different)
            counted = own.groupBy(range_of(F.col("value"), cuts, kind).alias("piece"))
            edges, start, listed = [low, *cuts, high], 0, []
            for piece, count, few in sorted(counted.agg(F.count("*"), F.approx_count_distinct("value")).collect()):
                # a range that no bound cuts is as small as the sample can make it
                listed.append((start, start + count, edges[piece], edges[piece + 1], few if cuts else most))
                start += count
            pieces[low, high] = listed
        for share, (low, high, place, different) in held.items():
            if different > most:
                start, _, low, high, few = next(p for p in pieces[low, high] if p[0] <= place < p[1])
                held[share] = (low, high, place - start, few)
    return {share: (low, high, place) for share, (low, high, place, _) in held.items()}


def nearest_rank(rows: DataFrame, column: str, shares: Sequence[float], ranges: int = 256, most: int = MOST_VALUES) -> DataFrame:
    """(share, value) with value = sorted[min(n - 1, int(n * share))].

    Ranges that hold a wanted place are narrowed down first; then the values of each such range are counted one
    by one and looked through in a task of its own, of about ``most`` values."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    kind = values.schema["value"].dataType.simpleString()
    held = narrowed(values, shares, ranges, most)
    wanted = [F.struct(_inside(low, high, kind).alias("inside"), F.lit(s).alias("share"), F.lit(place).cast("long").alias("place")) for s, (low, high, place) in held.items()]
    listed = F.array(*wanted).cast("array<struct<inside:boolean,share:double,place:bigint>>")
    counts = values.where(F.exists(listed, lambda x: x["inside"])).groupBy("value").agg(F.count("*").alias("n"))
    placed = counts.select("value", "n", F.explode(F.filter(listed, lambda x: x["inside"])).alias("x")).select("value", "n", "x.share", "x.place")
    upto = Window.partitionBy("share").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("last", F.sum("n").over(upto) - 1)
    return running.where((F.col("place") <= F.col("last")) & (F.col("place") > F.col("last") - F.col("n"))).select("share", "value")


def _inside(low, high, kind: str) -> Column:
    """Whether ``value`` is at least ``low`` and under ``high`` (None: no bound)."""
    above = F.lit(True) if low is None else F.col("value") >= F.lit(low).cast(kind)
    return above if high is None else above & (F.col("value") < F.lit(high).cast(kind))


def archetypes() -> Column:
    """Labels of a feature row; a row may have several or none."""
    has = lambda c: F.size(F.col(c)) > 0
    grounded, shipped = has("career_retrieval_terms"), has("career_production_terms")
    stuffed = tx.strings(("non_tech_ai_keyword_stuffing", "ai_terms_without_career_evidence"))
    return sc.present(
        (F.col("ai_title") & grounded & shipped, "strong_ai_search_ranking_engineer"),
        (F.col("adjacent_title") & grounded, "adjacent_backend_data_engineer"),
        (F.col("ai_title") & shipped & ~grounded, "product_ml_generalist"),
        (F.contains("title_norm", F.lit("research")) & ~shipped, "pure_research_candidate"),
        (F.arrays_overlap(risk_flags(), stuffed), "ai_keyword_stuffer"),
        ((F.col("last_active_months") >= 6) & (F.col("response_rate") < 0.2), "stale_strong_or_stale_profile"),
        (F.col("service_only"), "service_only_candidate"),
    )


def sample_per_label(rows: DataFrame, labels: Column, key: str, k: int = 5) -> DataFrame:
    """Up to ``k`` rows of each label, by key."""
    listed = rows.withColumn("label", F.explode(labels))
    return listed.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(key))).where(F.col("n") <= k)


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    """How many rows have each flag, by flag."""
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n")).orderBy("flag")


def first_of_key(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_k", "_n")
