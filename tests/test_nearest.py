import numpy as np
import pytest
from pyspark.sql import functions as F

from meritlens.functions import vectors as vx
from meritlens.operators import matching, ranking

SCHEMA = "id long, v array<double>"


def plain(rows, queries, k):
    """All pairs: rescaled cosine in units of 1e-5, then id."""
    out = {}
    for q, a in queries:
        scored = []
        for i, b in rows:
            if i != q:
                n = np.linalg.norm(a if a is not None else 0) * np.linalg.norm(b if b is not None else 0)
                x = min(1.0, max(0.0, (np.dot(a, b) / n - 0.12) / 0.53)) if n else 0.0
                scored.append((-int(np.floor(x * 100_000 + 0.5)), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(search):
    out = {}
    for r in search.result().collect():
        out.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def clustered(seed, n=600, d=16, clusters=12, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d))
    return [(i, (centres[i % clusters] + spread * rng.standard_normal(d) * np.linalg.norm(centres[i % clusters]) / d**0.5).tolist()) for i in range(n)]


@pytest.mark.parametrize("k, pivots", [(1, 32), (10, 24), (70, 5)])
def test_clusters_are_skipped_and_no_neighbour_is_lost(spark, k, pivots):
    rows = clustered(k)
    table = spark.createDataFrame(rows, SCHEMA)
    search = matching.Nearest(table.where("id % 20 = 0"), table, "id", "v", k, pivots=pivots)
    queries = [r for r in rows if r[0] % 20 == 0]
    assert found(search) == plain(rows, queries, k)
    first = search.first()
    met = first.count() + search.rest(search.best(first).drop("rank")).count()
    if k <= 10:
        assert met < 0.5 * len(queries) * (len(rows) - 1)  # pairs that were scored


def test_directions_without_clusters(spark):
    """Bounds rule hardly anything out, and nothing is lost."""
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 24)))]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(matching.Nearest(table.where("id % 30 = 0"), table, "id", "v", 7)) == plain(rows, [r for r in rows if r[0] % 30 == 0], 7)


def test_zero_null_and_equal_vectors(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, 3.0]), (6, [1.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    for k in (2, 4, 9):
        assert found(matching.Nearest(table, table, "id", "v", k)) == plain(rows, rows, k)
    none = table.where("id < 2")
    assert found(matching.Nearest(none, none, "id", "v", 3)) == {0: [(1, 0)], 1: [(0, 0)]}
    assert matching.Nearest(table, table.limit(0), "id", "v", 3).result().count() == 0
    assert matching.Nearest(table.limit(0), table, "id", "v", 3).result().count() == 0


def test_odd_vectors_score_as_the_column_does(spark):
    """No finite length, null entries, other lengths: each pair as vectors.rescaled_cosine has it, equal keys left out, a null key never met."""
    nan, inf = float("nan"), float("inf")
    odd = [[1.0, nan], [inf, 1.0], [1e200, 1.0], [1.0, None], [1.0], [0.5, 0.5, 0.5], [], None, [0.0, 0.0], [-inf, inf], [nan]]
    rows = list(enumerate(odd + [[1.0, 0.1 * i] for i in range(20)] + [[2.0, 0.2 * i] for i in range(20)]))
    rows += [(3, [1.0, 0.3]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, SCHEMA)
    a, b = table.toDF("q", "a"), table.toDF("id", "b")
    score = F.floor(vx.rescaled_cosine(F.col("b"), F.col("a")) * 100_000 + 0.5)
    for k in (3, 30):
        want = ranking.top(a.join(b, F.col("q") != F.col("id")).withColumn("s", score), k, [F.col("s").desc(), F.col("id")], by=["q"]).select("q", "rank", "id", "s")
        got = matching.Nearest(table, table, "id", "v", k, pivots=5).result().select("query", "rank", "id", "score")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_a_cell_are_tasks_of_their_own(spark, monkeypatch):
    """However few bytes the vectors hold: one crowded cell is cut, and copies of a vector tie by key."""
    rows = [(i, [1.0, 0.001 * (i % 7), 0.0]) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(matching, "BLOCK_BYTES", 50 * 24, raising=False)
    search = matching.Nearest(table.where("id % 40 = 0"), table, "id", "v", 5, pivots=1)
    assert search.first().select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert found(search) == plain(rows, [r for r in rows if r[0] % 40 == 0], 5)
