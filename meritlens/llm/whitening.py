"""Whitening of embeddings by hierarchical SVD merging.

1. Every usable vector becomes whole numbers, ``x = floor(64 * c) + 1000000``; the fit list is each distinct
   x vector once (counted map-side, so that a vector of a third of all rows costs one row a task).
2. Each partition of the fit list keeps a state: how many vectors, their exact sums, their mean, and all
   singular values and right singular vectors of the centred vectors.  A further block of vectors is
   appended the same way as two states are merged: the triangles ``diag(s) V`` of both are stacked with one
   more row, the difference of the means times sqrt(n m / (n + m)), and decomposed again.  The stack's Gram
   matrix is the scatter of the union, so that no dimension and no variance is lost.
3. States meet FAN at a time in rounds of tasks, each round written to the shared folder; the driver gets
   one state of d x d numbers, whatever the number of rows or partitions.
4. Rows are projected on the first components; the fit list is projected, too, and its covariance gathered
   through the same rounds, which gives the error against the identity.

Edge cases: a null vector, one without entries, and one with null or non-finite entries is dropped; so is one
whose length is not that of most usable vectors (of equally frequent lengths the greatest counts).  64 * c
is held within 2^62 either way.  Repeated rows are returned as often as they occur, null ids as
null.  Vectors of fewer than COMPONENTS dimensions have as many components as dimensions.  A component without
variance (below rounding against the greatest) has explained 0 and whitened 0 and does not count in
the identity error.  ``deviation`` is null where it exceeds 64 bits.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.llm.common import discard, materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Bound of 64 * c, and rows that one decomposition takes in.
MOST, BLOCK = 1 << 62, 4096
#: States that one task merges.
FAN = 16


@dataclass
class State:
    """What is kept of a set of vectors: number, exact sums (as offsets from OFFSET), mean, and ``diag(s) V``."""

    n: int
    sums: list[int]
    mean: np.ndarray
    triangle: np.ndarray

    def __add__(self, other: State) -> State:
        n = self.n + other.n
        step = other.mean - self.mean
        seam = step * np.sqrt(self.n / n * other.n)
        return State(
            n,
            [a + b for a, b in zip(self.sums, other.sums)],
            self.mean + step * (other.n / n),
            decomposed(np.vstack([self.triangle, other.triangle, seam])),
        )


def decomposed(rows: np.ndarray) -> np.ndarray:
    """``diag(s) V`` of the singular value decomposition of ``rows``: the same Gram matrix in at most d rows."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def state_of(x: np.ndarray) -> State:
    """State of a block of whole or broken numbers (rows x d)."""
    mean = x.mean(axis=0)
    return State(len(x), exact_sums(x), mean, decomposed(x - mean))


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of whole numbers by halves of 32 bits, which do not overflow; zeros for broken numbers."""
    if x.dtype != np.int64:
        return [0] * x.shape[1]
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low)]


STATE = "id long, n long, sums array<decimal(38,0)>, mean array<double>, triangle array<double>"


def _written(number: int, s: State) -> pa.RecordBatch:
    columns = [[number], [s.n], [s.sums], [s.mean.tolist()], [s.triangle.ravel().tolist()]]
    exact = pa.array([[str(v) for v in s.sums]], pa.list_(pa.string())).cast(pa.list_(pa.decimal128(38, 0)))
    kinds = [pa.int64(), pa.int64(), None, pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([exact if k is None else pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "n", "sums", "mean", "triangle"])


def _read(row: dict) -> State:
    mean = np.array(row["mean"])
    return State(row["n"], [int(v) for v in row["sums"]], mean, np.array(row["triangle"]).reshape(-1, len(mean)))


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows x d of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _fold(column: str, turned: Callable[[np.ndarray], np.ndarray]):
    """One state for each task that has rows."""

    def run(batches):
        from pyspark import TaskContext

        held = None
        for batch in batches:
            x = turned(_matrix(batch.column(batch.schema.get_field_index(column)), np.int64))
            for at in range(0, len(x), BLOCK):
                own = state_of(x[at : at + BLOCK])
                held = own if held is None else held + own
        if held is not None:
            yield _written(TaskContext.get().partitionId(), held)

    return run


def _merge(batches):
    """States that follow each other by group become one for each group."""
    held: dict[int, State] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = _read(row)
            held[row["id"]] = held[row["id"]] + own if row["id"] in held else own
    for number, state in held.items():
        yield _written(number, state)


def merged(spark: SparkSession, vectors: DataFrame, column: str, turned: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> State | None:
    """The state of all vectors of ``column``, after ``turned``, merged FAN at a time; None without rows."""
    states = materialize(spark, vectors.select(column).mapInArrow(_fold(column, turned), STATE), "whitening-states")
    while (n := states.count()) > FAN:
        groups = -(-n // FAN)
        numbered = states.withColumn("id", F.pmod(F.col("id"), F.lit(groups))).repartition(groups, "id")
        following = materialize(spark, numbered.mapInArrow(_merge, STATE), "whitening-states")
        discard(spark, states)
        states = following
    last = [_read(r.asDict()) for r in states.orderBy("id").collect()]
    discard(spark, states)
    return reduce(State.__add__, last) if last else None


def whole_numbers(vector: str) -> Column:
    """floor(64 * c) of each entry, that is x without its offset; null if the vector cannot be used."""
    entries = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * SCALE)
    held = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c, F.lit(float(MOST))), F.lit(float(-MOST)))))
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & (F.size(entries) > 0)
    return F.when(usable, held)


@dataclass
class Fit:
    """Size and exact sums of the fit list, unit components by falling variance, variances, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @classmethod
    def of(cls, state: State, most: int) -> Fit:
        _, s, v = np.linalg.svd(state.triangle, full_matrices=True)
        values = np.zeros(len(v))
        values[: len(s)] = s**2 / state.n
        rounding = values[0] * len(v) * np.finfo(float).eps * 16
        return cls(state.n, state.sums, v[:most], np.where(values > rounding, values, 0.0)[:most], float(values.sum()))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred exactly where n * x fits 64 bits, projected, and scaled."""
        scale = np.divide(1.0, np.sqrt(self.variances), out=np.zeros(len(self.variances)), where=self.variances > 0)
        return self.centred(x).astype(float) / self.n @ self.components.T * scale

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as 64-bit numbers if they fit, else as Python's."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        whole = np.int64 if bound < 1 << 63 else object
        return x.astype(whole) * self.n - np.array(self.sums, dtype=whole)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond 64 bits."""
        apart = self.centred(x)
        widest = max(abs(int(apart.max(initial=0))), abs(int(apart.min(initial=0))))
        if widest**2 * apart.shape[1] >= 1 << 63:
            apart = apart.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def fit(spark: SparkSession, vectors: DataFrame, column: str = "x", most: int = COMPONENTS) -> Fit | None:
    """Components of distinct ``vectors``; None without rows."""
    state = merged(spark, vectors, column)
    return None if state is None else Fit.of(state, most)


def identity_error(spark: SparkSession, vectors: DataFrame, found: Fit, column: str = "x") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    state = merged(spark, vectors, column, found.whitened)
    apart = state.triangle.T @ state.triangle / state.n - np.eye(len(found.variances))
    counted = found.variances > 0
    return float(np.abs(apart[np.ix_(counted, counted)]).max(initial=0.0))


def _projected(found: Fit):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column(1), np.int64)
                values = found.whitened(x)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * values.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found.deviations(x), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                    names=["vec_id", "deviation", "values"],
                )

    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(spark: SparkSession, embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, as RESULT."""
    usable = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"), whole_numbers(vector).alias("x")).where("x is not null")
    lengths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    usable = usable.where(F.size("x") == lengths.d)
    distinct = materialize(spark, usable.select("x").distinct(), "whitening-fit")
    found = fit(spark, distinct, most=most)
    error = identity_error(spark, distinct, found)
    discard(spark, distinct)
    explained = F.array(*(F.lit(float(v / found.trace) if found.trace else 0.0) for v in found.variances))
    rows = usable.mapInArrow(_projected(found), "vec_id long, deviation long, values array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("values").alias("i", "whitened")).select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op11(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return whiten(spark, embeddings)
