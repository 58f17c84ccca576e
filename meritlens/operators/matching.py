"""Every candidate against every requirement, through words and vectors.

With one job the requirements are literals and a row is matched in place, without a join or a
shuffle.  Tables of requirements are matched by :func:`match_table`."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from meritlens.functions import cosines
from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.functions import vectors as vx
from meritlens.functions.cosines import ship_package
from meritlens.operators import ranking
from meritlens.operators.requirements import Requirement

COVERED = 0.30


def matches(
    requirements: Sequence[Requirement],
    tokens: str = "match_tokens",
    vector: str | None = None,
    embedded: Sequence[Sequence[float]] | None = None,
    alpha: float = vx.ALPHA,
    spans_from: str | None = None,
) -> Column:
    """array<struct> of a row's match with each requirement.

    The dense channel needs a vector for the row and one for each requirement; else words alone count."""
    dense_on = vector is not None and embedded is not None and len(embedded) == len(requirements)
    out = []
    for i, r in enumerate(requirements):
        words = tx.strings(r.keywords)
        lexical = tx.lexical_overlap(words, tokens)
        dense = F.lit(None).cast("double")
        if dense_on:
            own = F.array(*(F.lit(float(x)) for x in embedded[i]))
            dense = F.when(F.col(vector).isNotNull(), vx.rescaled_cosine(F.col(vector), own))
        found = tx.matched_keywords(words, tokens)
        score = vx.hybrid(dense, lexical, alpha)
        span = F.when(score >= COVERED, tx.best_span(found, spans_from)).otherwise("") if spans_from else F.lit("")
        out.append(F.struct(
            F.lit(i).alias("req_idx"), F.lit(r.text).alias("text"), F.lit(r.kind).alias("kind"),
            F.lit(float(r.weight)).alias("weight"), F.coalesce(dense, F.lit(0.0)).alias("dense"),
            lexical.alias("lexical"), score.alias("score"), found.alias("matched"), span.alias("span"),
        ))
    kind = (
        "array<struct<req_idx:int,text:string,kind:string,weight:double,dense:double,lexical:double,score:double,"
        "matched:array<string>,span:string>>"
    )
    return F.array(*out).cast(kind)


def summary(matched: str = "matches") -> Column:
    """struct(semantic_fit, lexical_fit, coverage, disqualifier) of a row's matches."""
    own = lambda kind: F.filter(matched, lambda m: m["kind"] == kind)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda a, m: a + f(m))
    must = F.filter(matched, lambda m: ~m["kind"].isin(lx.NICE, lx.DISQUALIFIER))

    def mean(c, f):
        weight = total(c, lambda m: m["weight"])
        return F.when(weight > 0, total(c, lambda m: m["weight"] * f(m)) / weight).otherwise(0.0)

    score, lexical = (lambda m: m["score"]), (lambda m: m["lexical"])
    covered = F.size(F.filter(must, lambda m: m["score"] >= COVERED))
    return F.struct(
        sc.rounded(F.least(F.lit(1.0), 0.85 * mean(must, score) + 0.15 * mean(own(lx.NICE), score)), 4).alias("semantic_fit"),
        sc.rounded(mean(F.col(matched), lexical), 4).alias("lexical_fit"),
        sc.rounded(F.when(F.size(must) > 0, covered / F.size(must)).otherwise(0.0), 4).alias("coverage"),
        sc.rounded(F.coalesce(F.array_max(F.transform(own(lx.DISQUALIFIER), score)), F.lit(0.0)), 4).alias("disqualifier"),
    )


def match_table(rows: DataFrame, requirements: DataFrame, id_col: str, tokens: str, alpha: float = vx.ALPHA) -> DataFrame:
    """(id, job_id, req_idx, kind, weight, lexical, matched) of rows against a requirement table.

    ``requirements`` has (job_id, req_idx, kind, weight, keywords).  Pairs arise only where a row has
    one of a requirement's keywords, by an inverted index on keywords; other pairs have lexical 0 and
    are implied.  The token side is shuffled with the keyword side; hot tokens are split by AQE."""
    index = requirements.select("job_id", "req_idx", "kind", "weight", F.size("keywords").alias("n"), F.posexplode("keywords").alias("k", "token"))
    listed = rows.select(F.col(id_col), F.explode(tokens).alias("token"))
    return (
        listed.join(index, "token")
        .groupBy(id_col, "job_id", "req_idx", "kind", "weight", "n")
        .agg(F.count("*").alias("hits"), F.sort_array(F.collect_list(F.struct("k", "token"))).alias("m"))
        .select(
            id_col, "job_id", "req_idx", "kind", "weight", (F.col("hits") / F.col("n")).alias("lexical"),
            F.transform("m", lambda x: x["token"]).alias("matched"),
        )
    )


def aggregate_table(
    pairs: DataFrame, requirements: DataFrame, id_col: str, rows: DataFrame, score: str = "lexical", digits: int | None = 4
) -> DataFrame:
    """(id, job_id, semantic_fit, lexical_fit, coverage, disqualifier) of every row of ``rows`` (id) for each
    job, from pairs of :func:`match_table`; not rounded if ``digits`` is None.

    The denominators come from the requirements, so pairs that were not formed count as 0, and a row
    without any has 0 throughout.  Sums go by the order of requirements, so that no shuffle moves a last digit;
    a row's pairs are at most a job's requirements.  Jobs are few and become literals."""
    kinds = {"must": lambda x: ~x["kind"].isin(lx.NICE, lx.DISQUALIFIER), "nice": lambda x: x["kind"] == lx.NICE, "all": lambda x: F.lit(True)}
    every = lambda *own: F.sort_array(F.collect_list(F.struct("req_idx", "kind", "weight", *own))).alias("x")
    total = lambda k, f: F.aggregate(F.filter("x", kinds[k]), F.lit(0.0), lambda a, x: a + f(x))
    count = lambda f: F.size(F.filter("x", f)).cast("long")
    totals = requirements.groupBy("job_id").agg(every()).select(
        "job_id", *(total(k, lambda x: x["weight"]).alias(f"{k}_weight") for k in kinds), count(kinds["must"]).alias("must_count")
    )
    scored = {"must": score, "nice": score, "all": "lexical"}
    sums = pairs.groupBy(id_col, "job_id").agg(every(*dict.fromkeys(("lexical", score)))).select(
        id_col, "job_id", *(total(k, lambda x, c=c: x["weight"] * x[c]).alias(f"{k}_sum") for k, c in scored.items()),
        count(lambda x: kinds["must"](x) & (x[score] >= COVERED)).alias("covered"),
        F.array_max(F.transform(F.filter("x", lambda x: x["kind"] == lx.DISQUALIFIER), lambda x: x[score])).alias("worst"),
    )
    jobs = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in t.asDict().items())) for t in totals.collect()))
    wanted = rows.select(id_col, F.explode(jobs).alias("job")).select(id_col, "job.*")
    found = wanted.join(sums, [id_col, "job_id"], "left").na.fill(0.0, ["all_sum", "must_sum", "nice_sum", "worst"]).na.fill(0, ["covered"])
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    shown = lambda c: c if digits is None else sc.rounded(c, digits)
    return found.select(
        id_col,
        "job_id",
        shown(F.least(F.lit(1.0), 0.85 * over("must_sum", "must_weight") + 0.15 * over("nice_sum", "nice_weight"))).alias("semantic_fit"),
        shown(over("all_sum", "all_weight")).alias("lexical_fit"),
        shown(over("covered", "must_count")).alias("coverage"),
        shown(F.col("worst")).alias("disqualifier"),
    )


#: Pivots of a vector search, bytes of a block of vectors (as doubles), slack of its bounds, and the cell that has none.
PIVOTS, BLOCK_BYTES, SLACK, WILD = 32, 4 << 20, 1e-7, -1


class Nearest:
    """The ``k`` best rows of each query by rescaled cosine (in units of 1 / ``units``, then key), itself excluded; exact.

    Each row belongs to the cell of its nearest pivot and keeps its angle to it.  Angles obey the triangle inequality,
    so that a query's angle to a pivot and the cell's least and greatest angle bound every score in the cell.  A query
    first visits its best cells until they hold ``k`` rows; their k-th score then rules cells out.
    Vectors that are null or zero are a cell of their own, of score 0; so are those without a finite length, which no bound rules out.
    Visits meet rows in blocks: a block of a cell's queries and a block of its rows are one product of matrices, of which
    each query keeps its ``k`` best.  Tasks hold a few blocks, however large a cell is, and are as many as the blocks need.
    ``pivots`` vectors and one line for each cell reach the driver."""

    def __init__(self, queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, units: int = 100_000, pivots: int = PIVOTS):
        self.key, self.k, self.units, self.spark = key, k, units, rows.sparkSession
        ship_package(self.spark)
        length = vx.length(F.col(vector))
        plain = rows.where((length > 0) & (length < float("inf")))
        picked = [[float(x) for x in r.v] for r in plain.orderBy(F.xxhash64(key), key).limit(pivots).select(F.col(vector).alias("v")).collect()]
        told = lambda df: self.told(df.where(F.col(key).isNotNull()).select(key, F.col(vector).alias("v")), picked)
        self.rows = told(rows).select(key, "v", "cell", F.array_min("angles").alias("angle"))
        cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
        listed = F.array(*(F.struct(*(F.lit(x).alias(c) for c, x in r.asDict().items())) for r in cells)).cast("array<struct<cell:int,n:bigint,low:double,high:double>>")
        asked = told(queries).select(F.col(key).alias("query"), F.col("v").alias("q"), "angles", (F.col("cell") == WILD).alias("wild"))
        theta = lambda c: F.get(F.col("angles"), c["cell"] - 1)
        apart = lambda c: F.greatest(F.lit(0.0), theta(c) - c["high"], c["low"] - theta(c))
        most = lambda c: F.when(F.col("wild") | (c["cell"] == WILD), F.lit(units).cast("long")).otherwise(self.most(apart(c)))
        ordered = F.array_sort(F.transform(listed, lambda c: F.struct((-most(c)).alias("most"), c["cell"].alias("cell"), c["n"].alias("n"))))
        before = lambda i: F.aggregate(F.slice("ordered", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        self.asked = asked.withColumn("ordered", ordered).withColumn(
            "cells", F.transform("ordered", lambda c, i: F.struct((-c["most"]).alias("most"), c["cell"].alias("cell"), (before(i) <= k).alias("first")))
        ).select("query", "q", "cells")
        most_rows = max(1, BLOCK_BYTES // (8 * max(1, max(map(len, picked), default=1))))
        self.blocks = max(1, -(-queries.count() // most_rows))
        parts = {r.cell: -(-r.n // most_rows) for r in cells}
        self.part = F.pmod(F.xxhash64(key), F.element_at(F.create_map(*(F.lit(x) for p in parts.items() for x in p)), F.col("cell"))) if parts else F.lit(0)
        met, cores = sum(parts.values()) * self.blocks, self.spark.sparkContext.defaultParallelism
        self.tasks = max(1, min(met, 4 * cores), met // 16)

    def told(self, vectors: DataFrame, pivots: list[list[float]]) -> DataFrame:
        """(key, v) with ``angles`` to the pivots and the ``cell``: from 1 the nearest pivot, 0 without direction, WILD without a finite length."""
        schema = vectors.schema

        def run(batches):
            centres = cosines.Vectors(pa.array(pivots, pa.list_(pa.float64())))
            for batch in batches:
                own = cosines.Vectors(batch.column(1))
                angles = np.arccos(np.clip(np.nan_to_num(cosines.cosines(own, centres)), -1.0, 1.0))
                angles[(own.dims[:, None] != centres.dims)] = np.pi  # no cosine, so no pivot of theirs
                cell = np.where(own.wild, WILD, np.where(own.plain, angles.argmin(axis=1) + 1 if pivots else 0, 0))
                ends = np.concatenate([[0], np.cumsum(own.plain * len(pivots))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(angles[own.plain].ravel()), mask=pa.array(~own.plain))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(cell, pa.int32())], names=[*schema.names, "angles", "cell"])

        return vectors.mapInArrow(run, StructType([*schema.fields, *StructType.fromDDL("angles array<double>, cell int").fields]))

    def rounded(self, score: Column) -> Column:
        return F.floor(score * self.units + 0.5).cast("long")

    def most(self, apart: Column) -> Column:
        """The greatest score, in units, at this angle or more; 0 where an angle is missing."""
        cosine = F.cos(F.greatest(apart - SLACK, F.lit(0.0)))
        return self.rounded(F.coalesce(sc.clamp((cosine - vx.COSINE_FLOOR) / (vx.COSINE_CEILING - vx.COSINE_FLOOR) + SLACK), F.lit(0.0)))

    def pairs(self, visits: DataFrame) -> DataFrame:
        """(query, key, score) of the visits (query, q, cell, least): all that may be among the ``k`` best, none under ``least``."""
        held = visits.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(self.blocks)).alias("block")).agg(
            F.collect_list(F.struct("query", "q", "least")).alias("asking")
        )
        rows = self.rows.groupBy("cell", self.part.alias("part")).agg(F.collect_list(F.struct(self.key, "v")).alias("rows"))
        met = rows.join(held, "cell").repartition(self.tasks, "cell", "part", "block").select("asking", "rows")
        k, units = self.k, self.units

        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    asking, rows = (c.slice(i, 1).flatten().flatten() for c in batch.columns)
                    yield from cosines.nearest(*asking, *rows, k, units)

        kind = self.rows.schema[self.key].dataType
        found = met.mapInArrow(run, StructType([StructField("query", kind), StructField("key", kind), StructField("score", LongType())]))
        return found.select("query", F.col("key").alias(self.key), "score")

    def first(self) -> DataFrame:
        """Pairs with the cells that a query visits first."""
        visits = self.asked.select("query", "q", F.explode(F.filter("cells", lambda c: c["first"])).alias("c"))
        return self.pairs(visits.select("query", "q", "c.cell", F.lit(0).cast("long").alias("least")))

    def rest(self, best: DataFrame) -> DataFrame:
        """Pairs with the other cells that may hold a row as good as the k-th of ``best``."""
        least = best.groupBy("query").agg(F.when(F.count("*") == self.k, F.min("score")).otherwise(0).alias("least"))
        known = self.asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
        visits = known.select("query", "q", "least", F.explode(F.filter("cells", lambda c: ~c["first"] & (c["most"] >= F.col("least")))).alias("c"))
        return self.pairs(visits.select("query", "q", "c.cell", "least"))

    def best(self, pairs: DataFrame) -> DataFrame:
        return ranking.top(pairs, self.k, [F.col("score").desc(), F.col(self.key)], by=["query"])

    def result(self) -> DataFrame:
        """(query, key, score, rank)."""
        near = self.best(self.first()).drop("rank")
        return self.best(near.unionByName(self.rest(near)))


def top_matches(matched: str = "matches", most: int = 4) -> Column:
    """The best positive matches (score, then requirement order)."""
    good = F.filter(matched, lambda m: (m["kind"] != lx.DISQUALIFIER) & (m["score"] >= COVERED))
    keyed = F.transform(good, lambda m: F.struct((-m["score"]).alias("s"), m["req_idx"].alias("i"), m.alias("m")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["m"])


def baseline_score(tokens: Column, spec_must: Sequence[str], spec_nice: Sequence[str]) -> Column:
    """Keyword-filter score: weight of the requirement words found over their whole weight."""
    words = [(w, 1.0) for t in spec_must for w in re.split(r"[\s/\-,]+", t.lower()) if len(w) >= 3]
    words += [(w, 0.4) for t in spec_nice for w in re.split(r"[\s/\-,]+", t.lower()) if len(w) >= 3]
    total = sum(w for _, w in words)
    if not total:
        return F.lit(0.0)
    found = sum((F.when(F.array_contains(tokens, k), w).otherwise(0.0) for k, w in words), F.lit(0.0))
    return F.coalesce(found / total, F.lit(0.0))

