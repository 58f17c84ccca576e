"""Cosines of many vectors with many, in Arrow batches: what :mod:`vectors` says of two arrays, for whole blocks."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from meritlens.functions import vectors as vx

#: Cells of a score matrix at once; what a product of matrices may be off by, in cosines and in parts of a unit.
TILE, OFF, UNSURE = 1 << 20, 1e-9, 1e-5

_shipped: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers if they would not find it by themselves, as when a
    script outside the repository put it on its own sys.path only."""
    root = Path(__file__).resolve().parents[2]
    seen = {os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    context = spark.sparkContext
    if str(root) in seen or root.name == "site-packages" or id(context) in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="meritlens-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/meritlens", "zip", root, "meritlens"))
    _shipped.add(id(context))


class Vectors:
    """A column of lists as one matrix, filled up with zeros.

    ``dims`` is -1 for a null vector and one with a null entry.  Lengths add up in the order of entries, as Spark's do.
    A ``wild`` vector has no finite length; its cosines are not those of unit vectors."""

    def __init__(self, column: pa.Array):
        self.dims = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        wide = int(self.dims.max(initial=0))
        there = np.arange(wide) < self.dims[:, None]
        self.values = np.zeros(there.shape)
        self.values[there] = flat.to_numpy(zero_copy_only=False)
        if flat.null_count:
            holes = np.zeros(there.shape, dtype=bool)
            holes[there] = flat.is_null().to_numpy(zero_copy_only=False)
            torn = holes.any(axis=1)
            self.values[torn], self.dims[torn] = 0.0, -1
        with np.errstate(over="ignore", invalid="ignore"):
            self.lengths = np.sqrt(sum((self.values[:, j] ** 2 for j in range(wide)), np.zeros(len(self.dims))))
            self.units = self.values / np.where(self.lengths == 0, 1.0, self.lengths)[:, None]
        self.wild = ~(self.lengths < np.inf)
        self.units[self.wild] = 0.0
        self.plain = ~self.wild & (self.lengths > 0)


def cosines(a: Vectors, b: Vectors) -> np.ndarray:
    """Every cosine, but for the last digits; 0 where there is none, NaN where only :func:`units` can tell."""
    wide = max(a.units.shape[1], b.units.shape[1])
    filled = lambda m: m if m.shape[1] == wide else np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    out = filled(a.units) @ filled(b.units).T
    out[a.wild], out[:, b.wild] = np.nan, np.nan
    if a.dims.min(initial=wide) < wide or b.dims.min(initial=wide) < wide:
        out[(a.dims[:, None] != b.dims) | (a.dims < 0)[:, None]] = 0.0
    return out


def units(a: Vectors, b: Vectors, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, scale: int) -> np.ndarray:
    """Rescaled cosines of the pairs (i, j), in units of 1 / ``scale``, as :func:`vectors.rescaled_cosine` has them.

    Pairs so near to the border of two units that the order of a sum may count are added up in the order of entries."""
    low, band = vx.COSINE_FLOOR, vx.COSINE_CEILING - vx.COSINE_FLOOR
    scaled = np.clip((cosine - low) / band, 0.0, 1.0) * scale + 0.5
    out = np.floor(scaled)
    for at in np.array_split(unsure := np.flatnonzero(~(np.abs(scaled - np.rint(scaled)) >= UNSURE)), len(unsure) // TILE + 1):
        x, y = i[at], j[at]
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            dot = sum((a.values[x, k] * b.values[y, k] for k in range(min(a.values.shape[1], b.values.shape[1]))), np.zeros(len(at)))
            n = a.lengths[x] * b.lengths[y]
            score = np.minimum(1.0, np.maximum(0.0, (dot / n - low) / band))
        score = np.where(n == 0, 0.0, np.where(np.isnan(score), 1.0, score))  # Spark's NaN is the greatest number
        out[at] = np.floor(score * scale + 0.5)
    return out.astype(np.int64)


def best(a: Vectors, b: Vectors, least: np.ndarray, shut: tuple[np.ndarray, np.ndarray], k: int, scale: int):
    """(i, j, score): the ``k`` first columns of each row by score in units, then place, that reach the row's ``least``.

    Columns from ``shut[0]`` up to ``shut[1]`` of a row are left out."""
    band, n = vx.COSINE_CEILING - vx.COSINE_FLOOR, len(b.dims)
    cut = np.where(least > 0, (least - 0.5) / scale * band + vx.COSINE_FLOOR - OFF, -np.inf)
    found = cosines(a, b)
    closed = np.zeros(found.shape, dtype=bool)
    for q in np.flatnonzero(shut[1] > shut[0]):
        closed[q, shut[0][q] : shut[1][q]] = True
    open_ = ~(found < cut[:, None]) & ~closed
    count = np.count_nonzero(open_, axis=1)
    dense = count > max(k, n // 8)  # whole rows are cheaper than a sort
    i, j = np.nonzero(open_ & ~dense[:, None])
    score = units(a, b, i, j, found[i, j], scale)
    if count[~dense].max(initial=0) > k:
        order = np.lexsort((j, -score, i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]  # i is in order already
        i, j, score = i[order], j[order], score[order]
    parts = [(i, j, score)]
    if len(many := np.flatnonzero(dense)):
        i, j = np.repeat(many, n), np.tile(np.arange(n), len(many))
        score = units(a, b, i, j, found[many].ravel(), scale)
        order = np.where(open_[many].ravel(), score * n + (n - 1 - j), -1).reshape(len(many), n)
        taken = (np.argpartition(order, n - k, axis=1)[:, n - k :] + np.arange(len(many))[:, None] * n).ravel()
        parts.append((i[taken], j[taken], score[taken]))
    i, j, score = (np.concatenate(x) for x in zip(*parts))
    kept = score >= least[i]
    return i[kept], j[kept], score[kept]


def nearest(query: pa.Array, asked: pa.Array, least: pa.Array, key: pa.Array, vectors: pa.Array, k: int, scale: int):
    """Batches of (query, key, score): :func:`best` of a block of queries with a block of rows, a row's own key excluded."""
    order = pc.sort_indices(key)
    key, rows, least = key.take(order), Vectors(vectors.take(order)), least.to_numpy(zero_copy_only=False)
    told = pc.unique(key)
    code = pc.index_in(key, told).to_numpy(zero_copy_only=False)
    own = pc.fill_null(pc.index_in(query, told), -1).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(code, own, "left"), np.searchsorted(code, own, "right")
    step = max(1, TILE // max(1, len(key)))
    for at in range(0, len(query), step):
        here = slice(at, at + step)
        i, j, score = best(Vectors(asked.slice(at, step)), rows, least[here], (low[here], high[here]), k, scale)
        yield pa.RecordBatch.from_arrays([query.take(pa.array(i + at)), key.take(pa.array(j)), pa.array(score)], names=["query", "key", "score"])
