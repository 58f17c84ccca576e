"""Adverse impact by the four-fifths rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOUR_FIFTHS, LEAST_GROUP = 0.80, 5


def group_rates(groups: DataFrame, selected: DataFrame, key: str, least: int = LEAST_GROUP) -> DataFrame:
    """(attribute, group_name, total, selected, rate, eligible, impact_ratio).

    ``groups`` has (attribute, key, group_name), ``selected`` the keys in the top.  Ratios are to the
    best rate of the groups that are large enough; with fewer than two of them they are null, and
    where nobody was selected they are 0."""
    chosen = selected.select(key).distinct().withColumn("_in", F.lit(1))
    rates = groups.join(chosen, key, "left").groupBy("attribute", "group_name").agg(
        F.count("*").alias("total"), F.count("_in").alias("selected")
    )
    rated = rates.withColumns({"rate": F.col("selected") / F.col("total"), "eligible": F.col("total") >= least})
    whole = Window.partitionBy("attribute")
    best = F.max(F.when(F.col("eligible"), F.col("rate"))).over(whole)
    enough = F.count_if("eligible").over(whole) >= 2
    ratio = F.col("rate") / F.when(best > 0, best).otherwise(1.0)
    return rated.withColumn("impact_ratio", F.when(F.col("eligible") & enough, ratio))


def verdicts(rates: DataFrame) -> DataFrame:
    """(attribute, min_impact_ratio, passes) with a row for the whole (attribute null); null where not assessed."""
    each = rates.groupBy("attribute").agg(F.min("impact_ratio").alias("min_impact_ratio"))
    each = each.withColumn("passes", F.col("min_impact_ratio") >= FOUR_FIFTHS)
    overall = each.agg(F.min("min_impact_ratio").alias("min_impact_ratio"), F.bool_and("passes").alias("passes"))
    return each.unionByName(overall.withColumn("attribute", F.lit(None).cast("string")))


def coverage_gap(ranked: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Ranked keys without a group label, for each attribute."""
    n = ranked.select(key).distinct()
    attributes = groups.groupBy("attribute").agg(F.countDistinct(key).alias("_n")).select("attribute")
    named = n.join(groups.select("attribute", key).distinct(), key).groupBy("attribute").agg(F.count("*").alias("labelled"))
    total = n.count()
    return attributes.join(named, "attribute", "left").select(
        "attribute", F.lit(total).alias("ranked"), (F.lit(total) - F.coalesce("labelled", F.lit(0))).alias("unlabelled")
    )
