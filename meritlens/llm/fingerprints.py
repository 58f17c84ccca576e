"""Threshold-scaled document fingerprints, in DataFrame operations only.

A sketch holds every 5-word shingle hash below a fixed fraction of the range of hashes (31 bits), so its
size follows the document, the sketch of a union is the union of sketches, and containment of a short
text in a long one can be estimated from the two sketches alone; likeness follows from the two
containments.  A text of fewer than five words has one shingle, one without words none.  A text none of whose hashes
is that low keeps its least hash alone, which is recognised by its value.  All estimates use nothing but
sketches: two texts with lone hashes are alike with 1 if those are equal, else 0, which is right on average, as
least hashes are equal with the probability of the similarity; a lone hash against a filled sketch gives 0, as
the sketch has hashes in the sampled range and the other text has none.

``neighbours`` pairs each row with the next one by descending doc_id without a global sort: ids are
cut into ranges at quantiles, each range's first row is also sent to the end of the range before
it, and ``lead`` works within ranges.  Texts are shuffled once.

Edge cases: null text counts as empty; a null doc_id sorts after all others; rows with the same
doc_id follow each other by descending text; a single row is its own neighbour; very long texts are
hashed whole; an empty table gives an empty result; other columns of the input are ignored.  Two
texts without words are alike (1), one is unlike any other text (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.functions.ranges import range_of

SHINGLE = 5
#: Hashes are below RANGE; one in SCALE is kept.
RANGE, SCALE = 1 << 31, 4
#: Ranges of doc_id for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 1 << 16
LOWEST = -(1 << 63)


def hashes_of(text: Column) -> Column:
    """All 31-bit shingle hashes of a text, in its order and with repeats."""
    plain = F.translate(F.lower(text), "\t\n\x0b\f\r", "     ")
    words = F.transform(F.filter(F.split(plain, " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    short = lambda h: F.shiftrightunsigned(h, 33).cast("int")

    def shingled(w: Column) -> Column:
        at = lambda i, k: F.get(w, i + k)
        n = F.size(w)
        return (
            F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: short(F.xxhash64(*(at(i, k) for k in range(SHINGLE))))))
            .when(n > 0, F.array(short(F.xxhash64(w))))
            .otherwise(F.array().cast("array<int>"))
        )

    return F.get(F.transform(F.array(words), shingled), 0)  # the words are worked out once


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of column ``text``: ascending 31-bit hashes, all below the cut, or the least alone."""
    listed = df.withColumn("_h", hashes_of(F.col(text)))
    low = F.sort_array(F.array_distinct(F.filter("_h", lambda h: h < RANGE // scale)))
    lone = F.filter(F.array(F.array_min("_h")), lambda h: h.isNotNull())
    return listed.withColumn(name, F.when(F.size(low) > 0, low).otherwise(lone)).drop("_h")


def written(sketch: str) -> Column:
    """A sketch as text: 8 hex digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def merged(a: str, b: str, scale: int = SCALE) -> Column:
    """Sketch of two texts together (shingles across the seam aside)."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda h: h < RANGE // scale)
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingle sets, from the containments c of a in b and d of b
    in a: 1 / (1 / c + 1 / d - 1), which is the share of the union that is common."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def neighbours(spark: SparkSession, docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each c of ``columns``: its value in the next row by
    descending doc_id."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = min(MOST_RANGES, max(1, parts * RANGES))
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST).cast("long"))
    share = [i / count for i in range(1, count)]
    keys = docs.select(key.alias("key"))
    found = keys.agg(F.percentile_approx("key", share, max(10_000, 20 * count)).alias("b")).first().b if share else None
    bounds = sorted(set(found or []))
    span = range_of(F.col("key"), bounds, "long")
    # one number for each range that has rows
    firsts = {r.range: r.key for r in keys.groupBy(span.alias("range")).agg(F.max("key").alias("key")).collect()}
    have = sorted(firsts)
    ahead = {p: have[i + 1] if i + 1 < len(have) else have[0] for i, p in enumerate(have)}
    top = F.array(*(F.lit(firsts.get(p, LOWEST)).cast("long") for p in range(len(bounds) + 1)))
    goes = F.array(*(F.lit(ahead.get(p, -1)).cast("int") for p in range(len(bounds) + 1)))
    home = F.struct(F.col("range"), F.lit(False).alias("copy"))
    away = F.struct(F.get(goes, F.col("range")).alias("range"), F.lit(True).alias("copy"))
    placed = (
        docs.withColumn("key", key)
        .withColumn("range", span.cast("int"))
        .withColumn("at", F.explode(F.when(F.get(top, F.col("range")) == F.col("key"), F.array(home, away)).otherwise(F.array(home))))
    )
    order = Window.partitionBy("at.range").orderBy(F.col("at.copy"), F.col("key").desc(), F.col("text").desc())
    following = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return following.where(~F.col("at.copy")).drop("at", "range", "key")


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = neighbours(spark, with_sketch(own, "text", "sketch"), ["text", "sketch"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third),
            F.substring(F.col("next_text"), F.lit(1), third),
        ),
    )
    sketched = with_sketch(edited.select("doc_id", "n_chars", "sketch", "next_sketch", "edited"), "edited", "edited_sketch")
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"),
        written("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("kept_in_edited"),
        containment("sketch", "next_sketch").alias("kept_in_next"),
    )
