"""From scores to ranks: near-tie bands, top-k, display scores, reranking, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.functions import scalars as sc
from meritlens.functions.ranges import order_bounds, order_of, range_of

EPSILON = 0.000001


def rank_order(score: str = "final_score", reach: str = "reach.score", key: str = "candidate_id") -> list[Column]:
    """Score to three places, then reachability, then id."""
    return [sc.rounded(F.col(score), 3).desc(), F.col(reach).desc(), F.col(key).asc()]


def top(rows: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows with their ``rank``, of all rows or of each group.

    Over all rows each partition keeps its best ``n`` and only those meet, so no full sort happens;
    within groups the group limit is pushed below the shuffle."""
    if by:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    head = rows.orderBy(*order).limit(n)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def display_scores(ranked: DataFrame, score: str = "final_score", by: Sequence[str] = ()) -> DataFrame:
    """A ranked head with ``display_score``, strictly falling by EPSILON where scores would not fall.

    The head (at most the top-k rows of a group) is folded in rank order."""
    keys = list(by)
    folded = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(score).alias("s")))).alias("rows"))
    start = F.array().cast("array<struct<rank:int,shown:double>>")

    def carry(done: Column, x: Column) -> Column:
        own = F.greatest(F.lit(0.0), x["s"])
        last = F.try_element_at(done, F.lit(-1))["shown"]
        shown = F.when(last.isNotNull() & (own >= last), F.greatest(F.lit(0.0), last - EPSILON)).otherwise(own)
        return F.array_append(done, F.struct(x["rank"].cast("int").alias("rank"), shown.alias("shown")))

    listed = folded.select(*keys, F.explode(F.aggregate("rows", start, carry)).alias("x"))
    return ranked.join(listed.select(*keys, "x.rank", F.col("x.shown").alias("display_score")), [*keys, "rank"])


def with_neighbour(ranked: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A ranked head with ``neighbour``, a struct of the next row's columns."""
    over = Window.partitionBy(*by).orderBy("rank")
    return ranked.withColumn("neighbour", F.lead(F.struct(*columns)).over(over))


def rerank(ranked: DataFrame, second: str, k: int = 50, blend: float = 0.5, score: str = "final_score") -> DataFrame:
    """The first ``k`` rows reordered by a blend with a second score, min-max scaled over them.

    Rows without the second score and those behind the head keep their places' order."""
    head, tail = ranked.where(F.col("rank") <= k), ranked.where(F.col("rank") > k)
    whole = Window.partitionBy()
    mixed = head.withColumn("_m", sc.rounded((1 - blend) * F.col(score) + blend * sc.min_max(F.col(second), whole), 6))
    mixed = mixed.withColumn("blended", F.coalesce("_m", F.col(score))).drop("_m")
    again = mixed.withColumn("new_rank", F.row_number().over(Window.orderBy(F.col("blended").desc(), F.col("rank"))))
    return again.unionByName(tail.withColumns({"blended": F.col(score), "new_rank": F.col("rank")}))


def rank_all(rows: DataFrame, score: str, key: str, by: Sequence[str] = (), ranges: int | None = None, name: str = "rank") -> DataFrame:
    """Every row with its rank by (score desc, key), of all or within groups, without one task that sorts everything.

    Rows are dealt out by ranges of (score, key), so that a score that most rows have is cut by its keys;
    they are numbered within a range, after the count of all ranges before it.  Only those counts, one for
    each group and range (as many as shuffle partitions), meet in a window.  Counts are taken from the
    dealt rows themselves, with a digest over all columns, so that Spark deals rows out (and works their scores
    out) once.  A null score ranks last."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order_of(score, key)
    kind = rows.select(order.alias("o")).schema["o"].dataType.simpleString()
    placed = rows.withColumn("_r", range_of(order, order_bounds(rows, score, key, max(2, ranges)), kind))
    dealt = placed.repartition(*by, "_r")
    counts = dealt.groupBy(*by, "_r").agg(F.count("*").alias("_count"), F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c in placed.columns))).alias("_all"))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_count").over(before), F.lit(0))
    starts = counts.where("_all is not null").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_r"])), start.alias("_start"))
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_r").orderBy(order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_r"])]
    rank = (F.col("_start") + F.col("_n")).cast("int")
    return numbered.join(starts, same).withColumn(name, rank).drop("_r", "_n", "_start", *(f"_k{i}" for i in range(len(by) + 1)))


def rank_by_keywords(rows: DataFrame, score: str, key: str, ranges: int | None = None) -> DataFrame:
    """Every row with ``keyword_rank`` by (score desc, key)."""
    return rank_all(rows, score, key, ranges=ranges, name="keyword_rank")


def rescued(head: DataFrame, keyword_ranks: DataFrame, key: str, cutoff: int, pool: int) -> DataFrame:
    """Rows of the head that the keyword ranking has behind ``cutoff`` (a missing row counts as last)."""
    joined = head.join(keyword_ranks.select(key, "keyword_rank"), key, "left").withColumn("keyword_rank", F.coalesce("keyword_rank", F.lit(pool)))
    return joined.where(F.col("keyword_rank") > cutoff)


def rank_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, rank, old_rank, change) of the new ranking; a new entry has no old rank."""
    return new.select(key, "rank").join(old.select(key, F.col("rank").alias("old_rank")), key, "left").withColumn(
        "change", F.col("old_rank") - F.col("rank")
    )


def overlap(ranked: DataFrame, by: str, key: str) -> DataFrame:
    """(a, b, shared, jaccard) of each two groups' sets of keys; pairs without a shared key count 0."""
    left, right = ranked.select(F.col(by).alias("a"), key), ranked.select(F.col(by).alias("b"), key)
    shared = left.join(right, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = ranked.groupBy(by).agg(F.count("*").alias("n"))
    groups = sizes.agg(F.sort_array(F.collect_list(F.struct(by, "n"))).alias("g"))
    pairs = groups.select(
        F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(F.filter("g", lambda y: y[by] > x[by]), lambda y: F.struct(
            x[by].alias("a"), y[by].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))))).alias("p")
    ).select("p.*")
    both = F.coalesce("shared", F.lit(0))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", both.alias("shared"), (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))


def boundary_rows(ranked: DataFrame, windows: Sequence[tuple[int, int]] = ((8, 12), (20, 30), (90, 100))) -> DataFrame:
    """Rows near the places where lists are cut, named by window."""
    name = None
    for low, high in windows:
        label = f"{low}-{high}"
        name = F.when(F.col("rank").between(low, high), label) if name is None else name.when(F.col("rank").between(low, high), label)
    return ranked.withColumn("window", name).where("window is not null")


def boundary_pairs(ranked: DataFrame, key: str, score: str, at: Sequence[int] = (10, 25, 100)) -> DataFrame:
    """The two rows on either side of each cut and the score between them."""
    own = ranked.select("rank", key, score)
    other = own.select(F.col("rank").alias("r2"), F.col(key).alias("below"), F.col(score).alias("s2"))
    return (
        own.where(F.col("rank").isin(*at)).join(other, F.col("rank") + 1 == F.col("r2"))
        .select("rank", F.col(key).alias("above"), "below", (F.col(score) - F.col("s2")).alias("gap"))
    )
