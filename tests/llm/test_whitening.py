import math

import numpy as np
import pytest

from meritlens.llm import whitening
from meritlens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, x long, n string"


def vectors(seed, n=300, d=20):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) @ np.diag(np.linspace(2, 0.1, d)) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32)


def plain(rows):
    """By the definition: (vec_id, x) of usable rows, n, sums, eigenvalues and eigenvectors of the exact covariance."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in usable})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, own = np.linalg.eigh(centred.T @ centred / n)
    return usable, n, sums, values[::-1], own[:, ::-1].T


def check(got, rows, most=16):
    usable, n, sums, values, own = plain(rows)
    k = min(most, len(sums))
    assert len(got) == k * len(usable)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        signs = set()
        for i, x in usable:
            r = by[i][c][0]
            exact = [n * v - s for v, s in zip(x, sums)]
            assert r.n == n and r.deviation == sum(v * v for v in exact)
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9
            expected = float(np.dot(np.array(exact) / n, own[c - 1]) / np.sqrt(values[c - 1]))
            assert abs(r.whitened) == pytest.approx(abs(expected), abs=1e-7)
            if abs(expected) > 1e-6:
                signs.add(r.whitened * expected > 0)
        assert len(signs) == 1


@pytest.mark.parametrize("parts, fan", [(1, 16), (7, 16), (11, 2)])
def test_equals_definition(spark, monkeypatch, parts, fan):
    """However rows are dealt out and states are merged."""
    monkeypatch.setattr(whitening, "FAN", fan)
    monkeypatch.setattr(whitening, "BLOCK", 50)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1))]
    frame = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], SCHEMA).repartition(parts)
    check(whitening.op11(spark, frame).collect(), rows)


def test_awkward_rows(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(2, 60, 5))]
    rows += [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    rows += [(105, rows[3][1]), (105, rows[3][1])]  # copies count once in the fit list and are all returned
    frame = spark.createDataFrame([(i, v, i, "clash") for i, v in [*rows, (106, [1.0, 2.0])]], SCHEMA)
    check(whitening.op11(spark, frame).collect(), rows)
    assert whitening.op11(spark, frame.where("vec_id = 100")).count() == 0
    assert whitening.op11(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_states_merge_without_loss():
    x = np.floor(vectors(3, 200, 12) * 64).astype(np.int64)
    whole = whitening.state_of(x)
    parts = [whitening.state_of(x[a:b]) for a, b in ((0, 1), (1, 5), (5, 90), (90, 200))]
    for order in ((0, 1, 2, 3), (3, 1, 0, 2)):
        held = parts[order[0]]
        for k in order[1:]:
            held = held + parts[k]
        assert held.n == 200 and held.sums == whole.sums == x.sum(axis=0).tolist()
        np.testing.assert_allclose(held.mean, whole.mean)
        np.testing.assert_allclose(held.triangle.T @ held.triangle, whole.triangle.T @ whole.triangle, rtol=1e-10, atol=1e-7)


def test_no_variance(spark):
    """One vector only: all components without variance; then one dimension that varies."""
    frame = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.op11(spark, frame).collect()} == {(1, 0, 0.0, 0.0, 0.0)}
    frame = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.25]), (None, [1.5, 0.25])], "vec_id long, embedding array<double>")
    got = whitening.op11(spark, frame).collect()
    assert len(got) == 6 and {r.explained for r in got if r.component == 1} == {1.0}
    assert {r.whitened for r in got if r.component == 2} == {0.0} and {r.identity_error < 1e-12 for r in got} == {True}


def test_very_large_entries(spark):
    """Held within 64 bits; deviations beyond that are null."""
    frame = spark.createDataFrame([(i, [s * 1e300, float(i)]) for i, s in enumerate((1, -1, 1, 0))], "vec_id long, embedding array<double>")
    got = whitening.op11(spark, frame).collect()
    assert len(got) == 8 and {r.deviation for r in got} == {None} and {r.n for r in got} == {4}


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "embeddings")
    check(whitening.op11(spark, docs).collect(), [(r.vec_id, r.embedding) for r in docs.collect()])
