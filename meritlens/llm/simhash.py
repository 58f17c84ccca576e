"""SimHash near-duplicate linking by the generalised pigeonhole principle.

Distinct fingerprints are linked when they differ in at most ``TAU`` bits:

1. Bits that vary together are put into the same partition (correlations over all fingerprints).
2. A dynamic programme gives each partition its own threshold.  With m partitions the thresholds
   add up to TAU - m + 1 (-1 leaves a partition out), so any pair within TAU bits agrees within
   the threshold in at least one partition.  Costs are candidate counts measured over all
   fingerprints.
3. Every fingerprint is indexed under its partition values and probes the values within the
   threshold; candidates are verified on all 64 bits.

A bucket over ``CROWD`` rows is not compared pair by pair.  Its fingerprints go through unit balls:
each is listed under itself and its 64 one-bit neighbours.  Two fingerprints are within two bits
exactly if their balls meet, and at most 65 distinct ones can be listed under one value, so the
links are complete, need no verification, and no group grows with the input.

Edge cases: null or empty text and text without words has fingerprint zero and is linked like any
other; repeated rows are returned as often as they occur; rows that share a doc_id join the
components of all their texts, as results name documents by id; a null doc_id never becomes a component
id unless its whole component has none; very long texts are hashed in blocks of shingles; an empty
table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.llm.common import discard, materialize, slices, texts_of

TAU = 2
#: Rows in a bucket up to which its members are compared pair by pair.
CROWD = 48
BLOCK = 1 << 16


def hashes_of(words: list[bytes], size: int):
    """The hashes of the shingles of ``size`` words, repeats included, and how many there are."""
    h = xxhash.xxh64_intdigest
    if len(words) < size:
        return iter([h(b" ".join(words), 42)]), 1
    return (h(b" ".join(s), 42) for s in zip(*(islice(words, k, None) for k in range(size)))), len(words) - size + 1


def _sums(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many hashes of the shingles of ``size`` words have each bit, and how many there are."""
    hashes, total = hashes_of(words, size)
    counts = np.zeros(64, dtype=np.int64)
    for _ in range(0, total, BLOCK):
        counts += ones(np.fromiter(islice(hashes, BLOCK), dtype="<u8"))
    return counts, total


def ones(block: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def packed(counts: np.ndarray, total: int) -> np.ndarray:
    return np.packbits(counts * 2 > total, bitorder="little").view("<u8")


def fingerprint(text: str) -> int:
    """SimHash of one text: a bit is 1 if set in over half of the 3-word shingles' hashes."""
    words = words_of(text)
    return int(packed(*_sums(words, 3))[0]) if words else 0


def _fingerprint_batches(batches):
    for batch in batches:
        for start, stop in slices(batch, "text"):
            prints = np.array([fingerprint(t) for t in texts_of(batch, "text", start, stop)], dtype=np.uint64)
            ids = batch.column(0).slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


def _bit_counts(batches):
    together, n = None, 0
    for batch in batches:
        n += batch.num_rows
        if together is None:
            together = np.zeros((batch.num_columns, 64, 64))
        for k, column in enumerate(batch.columns):
            fps = column.to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), BLOCK):
                block = np.ascontiguousarray(fps[at : at + BLOCK])
                bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                together[k] += bits.T @ bits
    if n:
        flat = together.reshape(-1, 64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(len(flat), dtype=np.int32)),
                pa.array(np.full(len(flat), n, dtype=np.int64)),
                *(pa.array(flat[:, j]) for j in range(64)),
            ],
            names=["bit", "n", *(f"c{j}" for j in range(64))],
        )


def bit_statistics(nodes: DataFrame, columns: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """For each fingerprint column the share of ones of its bits and their absolute correlations; the number of rows."""
    schema = "bit int, n long, " + ", ".join(f"c{j} double" for j in range(64))
    parts = nodes.select(*columns).mapInArrow(_bit_counts, schema)
    together, n = np.zeros((64 * len(columns), 64)), 0
    for r in parts.groupBy("bit").agg(F.sum("n"), *(F.sum(f"c{j}") for j in range(64))).collect():
        together[r[0]], n = r[2:], r[1]
    shares, correlations = [], []
    for counts in np.split(together, len(columns)):
        p = counts.diagonal() / n if n else np.full(64, 0.5)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
        shares.append(p)
        correlations.append(np.abs(counts / n - np.outer(p, p)) / np.outer(spread, spread) if n else np.eye(64))
    return shares, correlations, n


def arrange(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal size, each grown from a seed by the most correlated bit left."""
    left, parts = set(range(64)), []
    for k in range(m):
        size = 64 * (k + 1) // m - 64 * k // m
        rest = sorted(left)
        inner = corr[np.ix_(rest, rest)].copy()
        np.fill_diagonal(inner, 0)
        part = [rest[int(inner.sum(axis=1).argmax())]]
        left.discard(part[0])
        while len(part) < size:
            rest = sorted(left)
            part.append(rest[int(corr[np.ix_(rest, part)].sum(axis=1).argmax())])
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1, 0, 1, ...; costs[i][t + 1]) adding up to ``total`` at the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, c in enumerate(row):
                found = (cost + c, [*chosen, k - 1])
                if used + k - 1 not in step or found < step[used + k - 1]:
                    step[used + k - 1] = found
        best = step
    return best[total]


def plan(nodes: DataFrame) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is used."""
    (p,), (corr,), n = bit_statistics(nodes, ["fp"])
    layouts = {m: arrange(corr, m) for m in (2, 3)}
    parts = [(m, k, bits) for m, layout in layouts.items() for k, bits in enumerate(layout)]
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(b))).alias("v")) for i, (_, _, b) in enumerate(parts)))
    same = {
        r.part: r.pairs
        for r in nodes.select(F.explode(keys).alias("k"))
        .groupBy("k.part", "k.v")
        .agg(F.count("*").alias("n"))
        .groupBy("part")
        .agg(F.sum(F.col("n") * F.least(F.col("n") - 1, F.lit(CROWD + 65)).cast("double")).alias("pairs"))
        .collect()
    }
    ratio = 2 * p * (1 - p) / (p**2 + (1 - p) ** 2)
    found = []
    for m, layout in layouts.items():
        costs = []
        for k, bits in enumerate(layout):
            pairs = same.get(next(i for i, x in enumerate(parts) if x[:2] == (m, k)), 0.0)
            r = ratio[bits]
            wider = [1.0, 1 + r.sum(), 1 + r.sum() + (r.sum() ** 2 - (r**2).sum()) / 2]
            w = len(bits)
            rows = [n, n * (1 + w), n * (1 + w + w * (w - 1) / 2)]
            costs.append([0.0] + [pairs * wider[t] + 4.0 * rows[t] for t in range(3)])
        cost, chosen = allocate(costs, TAU - m + 1)
        found.append((cost, m, [(b, t) for b, t in zip(layout, chosen) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _flips(bits: list[int], threshold: int) -> list[tuple[int, int]]:
    """(bits to flip, how many) within the threshold."""
    out = [(0, 0)]
    if threshold >= 1:
        out += [(mask_of([b]), 1) for b in bits]
    if threshold >= 2:
        out += [(mask_of([a, b]), 2) for i, a in enumerate(bits) for b in bits[:i]]
    return out


def _probe(part: int, bits: list[int], threshold: int) -> Column:
    """Keys (part, v, d) under which a fingerprint looks; d = 0 is also where it is indexed."""
    mask = F.lit(mask_of(bits)).cast("long")
    flips = F.array(
        *(F.struct(F.lit(f).cast("long").alias("f"), F.lit(d).alias("d")) for f, d in _flips(bits, threshold))
    )
    return F.transform(
        flips,
        lambda x: F.struct(
            F.lit(part).alias("part"), F.col("fp").bitwiseXOR(x["f"]).bitwiseAND(mask).alias("v"), x["d"].alias("d")
        ),
    )


def _probes(parts: list[tuple[list[int], int]]) -> Column:
    return F.concat(*(_probe(i, bits, t) for i, (bits, t) in enumerate(parts)))


def links(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Edges (u, v), u < v, between the nodes (fp, node) whose fingerprints differ in <= TAU bits."""
    parts = plan(nodes)
    listed = nodes.select("fp", "node", F.explode(_probes(parts)).alias("k")).select("fp", "node", "k.part", "k.v", "k.d")
    crowds = listed.groupBy("part", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spark, listed.join(crowds, ["part", "v"]), "simhash-buckets")
    light = shared.where(F.col("n") <= CROWD)
    a = light.where("d = 0").select("part", "v", F.col("fp").alias("fa"), F.col("node").alias("a"))
    b = light.select("part", "v", F.col("fp").alias("fb"), F.col("node").alias("b"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    pairs = (
        a.join(b, ["part", "v"]).where((near <= TAU) & (F.col("a") != F.col("b"))).select("a", "b")
    )
    crowded = shared.where(F.col("n") > CROWD).groupBy("fp").agg(F.min("node").alias("node"))
    ball = F.transform(
        F.array(F.lit(0).cast("long"), *(F.lit(mask_of([j])).cast("long") for j in range(64))),
        lambda f: F.col("fp").bitwiseXOR(f),
    )
    met = (
        crowded.select("node", F.explode(ball).alias("z"))
        .groupBy("z")
        .agg(F.collect_list("node").alias("nodes"))
        .where(F.size("nodes") > 1)
        .select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b"))
        .where("a != b")
    )
    return pairs.unionByName(met).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(v, root) for each node of an edge but the roots; root is the component's smallest node.

    Large-star and small-star rounds alternate until the edges stop changing; each round is
    written to the shared folder."""

    def state(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    current = materialize(spark, edges.select("u", "v"), "simhash-edges")
    seen = state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        kept = large.join(low, "v")
        small = (
            kept.where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
            .unionByName(low.select(F.col("m").alias("u"), "v"))
            .where("u < v")
            .distinct()
        )
        following = materialize(spark, small, "simhash-edges")
        now = state(following)
        discard(spark, current)
        current = following
        if now == seen:
            return current.select("v", F.col("u").alias("root"))
        seen = now


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = materialize(spark, fingerprints(docs), "simhash-prints")
    nodes = materialize(
        spark, prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes"
    )
    roots = components(spark, links(spark, nodes.where("node is not null")))
    named = nodes.join(roots.withColumnRenamed("v", "node"), "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = near_duplicates(spark, docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
