"""Rank quality by graded labels, per query in one pass; adversarial gains; agreement of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RELEVANT = 3
CUTS = (10, 50)
#: Ranks that count for the rates of the head, and ranks that one block of the aggregation takes.
HEAD, BLOCK = 100, 1 << 16


def labelled(ranking: DataFrame, labels: DataFrame, key: str, default: float = 0.0) -> DataFrame:
    """A ranking with ``grade``; rows without a label get the default."""
    grades = labels.select(key, F.col("grade").cast("double").alias("grade"))
    return ranking.join(grades, key, "left").withColumn("grade", F.coalesce("grade", F.lit(float(default))))


def metrics(graded: DataFrame, by: Sequence[str]) -> DataFrame:
    """NDCG, average precision, precision, honeypot rates and the composite of each query.

    ``graded`` has ``by``, ``rank`` (from 1, without gaps) and ``grade`` (not negative).  The ideal order is that of
    the list itself; a list shorter than a cut is not charged for missing places.

    Rows without a grade count in the head alone and go no further.  One aggregation by blocks of BLOCK ranks gives
    each block's sums, its best grades, and of its hits their number n, the sum of 1 / rank, and the sum
    of (place within the block) / rank; with s hits in the blocks before, the block adds the latter
    plus s times the former to the sum of precisions.  No list is sorted or numbered as a whole."""
    rows = graded.select(*by, "rank", "grade").where((F.col("grade") != 0) | (F.col("rank") <= HEAD))
    hit = F.col("grade") >= RELEVANT
    within = lambda k, v: F.when(F.col("rank") <= k, v)
    rates = {f"p_{k}": (k, hit) for k in (5, 10)} | {f"honeypot_{k}": (k, F.col("grade") == 0) for k in (10, HEAD)}
    blocks = rows.groupBy(*by, F.floor((F.col("rank") - 1) / BLOCK).alias("_block")).agg(
        *(F.sum(within(k, F.col("grade") / F.log2(F.col("rank") + 1))).alias(f"dcg_{k}") for k in CUTS),
        *(F.sum(within(k, v.cast("int"))).alias(c) for c, (k, v) in rates.items()),
        *(F.count(within(k, F.lit(1))).alias(f"_of_{c}") for c, (k, _) in rates.items()),
        F.slice(F.sort_array(F.collect_list("grade"), asc=False), 1, max(CUTS)).alias("_best"),
        F.sort_array(F.collect_list(F.when(hit, F.col("rank")))).alias("_hits"),
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns({
        "_n": F.size("_hits"),
        "_own": total(F.transform("_hits", lambda r, i: (i + 1) / r)),
        "_each": total(F.transform("_hits", lambda r: 1 / r)),
    }).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = placed.groupBy(*by).agg(
        *(F.coalesce(F.sum(f"dcg_{k}"), F.lit(0.0)).alias(f"dcg_{k}") for k in CUTS),
        *(F.when(F.sum(f"_of_{c}") > 0, F.sum(c) / F.sum(f"_of_{c}")).otherwise(0.0).alias(c) for c in rates),
        F.slice(F.sort_array(F.flatten(F.collect_list("_best")), asc=False), 1, max(CUTS)).alias("_ideal"),
        F.when(F.sum("_n") > 0, F.sum(F.col("_own") + F.col("_before") * F.col("_each")) / F.sum("_n")).otherwise(0.0).alias("map"),
    )
    for k in CUTS:
        ideal = total(F.transform(F.slice("_ideal", 1, k), lambda g, i: g / F.log2(i + 2)))
        found = found.withColumn(f"ndcg_{k}", F.when(ideal == 0, 0.0).otherwise(F.col(f"dcg_{k}") / ideal))
    composite = 0.50 * F.col("ndcg_10") + 0.30 * F.col("ndcg_50") + 0.15 * F.col("map") + 0.05 * F.col("p_10")
    return found.withColumn("composite", composite).drop("_ideal", *(f"dcg_{k}" for k in CUTS))


def mean_rank(ranked: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Mean rank and number in the first ten of the members of a set."""
    return ranked.join(members.select(key).distinct(), key, "left_semi").agg(
        F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") <= 10).alias("in_top_10"), F.count("*").alias("n")
    )


def attack_rates(pairs: DataFrame, gain: float = 0.02) -> DataFrame:
    """Share of attacks resisted, by attack and over all (attack null).

    ``pairs`` has attack, score_before, score_after and flagged; an attack is resisted if it is
    flagged or gains no more than ``gain``."""
    resisted = F.col("flagged") | (F.col("score_after") - F.col("score_before") <= gain)
    rated = pairs.withColumn("resisted", resisted.cast("int"))
    return rated.groupingSets([["attack"], []], "attack").agg(
        F.avg("resisted").alias("resistance"), F.avg(F.col("score_after") - F.col("score_before")).alias("mean_gain"), F.count("*").alias("n")
    )


def largest_change(before: DataFrame, after: DataFrame, key: str, score: str = "final_score") -> DataFrame:
    """Largest absolute change of a score between two runs over the same rows, and the range."""
    a, b = before.select(key, F.col(score).alias("a")), after.select(key, F.col(score).alias("b"))
    change = F.col("b") - F.col("a")
    return a.join(b, key).agg(F.max(F.abs(change)).alias("largest"), (F.max("b") - F.min("b")).alias("spread"))
