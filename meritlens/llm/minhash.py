"""MinHash near-duplicates: fast similarity sketches, banding, exact verification.

Two documents are linked if the sets of their 4-word shingles have a Jaccard similarity of 0.8 or more;
classes are the connected components of these links.

1. Each distinct shingle set gets a sketch of COORDINATES bins by fast similarity sketching.  In round r
   every shingle hash is thrown into a bin with a value, and a bin keeps its least (round, value).  In
   the first COORDINATES rounds the bin is drawn by the hash; in as many more, round r throws all into bin
   r - COORDINATES, so that every bin is filled at the end, however small the set.  Rounds stop when
   all bins are filled, after one or two for long texts.  Two sketches agree in a bin with
   the probability of the similarity, with the concentration of independent draws.
2. Bins are kept by 16 bits each; ROWS of them are the key of a band.  A pair at the similarity shares no band
   with a chance of (1 - 0.8^ROWS)^BANDS, 5 in 10^8.  Candidates whose sizes rule the similarity out
   are dropped, and those that agree in fewer than LEAST bins, 4.5 deviations under the expectation.
3. Candidates are verified by exact counts on the sets.

Buckets of up to SMALL sets are compared pair by pair.  In a larger one every set meets PIVOTS others, which
connects nearly all of a group of copies; then all pairs of the bucket that are not connected yet are
compared in blocks of tasks, sets outside the bucket's main component against all of it.  Blocks return
only links between components, so that nothing grows with the pairs of a group and no pair of a bucket is left
out.

Edge cases: null and empty texts and texts without words have the empty set and are linked with nothing;
texts of fewer than four words have one shingle; rows with equal sets are one node, returned as often as they
occur; different texts under one doc_id are judged each by itself; a null doc_id is linked like others, but is
no component's id unless no other is in it (then component_id is null, and the row is kept); very long texts
are hashed in blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.llm import similar
from meritlens.llm.common import discard, materialize, slices, texts_of
from meritlens.llm.simhash import components, hashes_of, words_of

#: Similarity of the shingle sets of linked documents, in hundredths.
PERCENT, SHINGLE = 80, 4
#: Bins of a sketch, and how many make up a band.
COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Bins that a pair at the similarity has in common but for 4.5 deviations.
LEAST = int(0.8 * COORDINATES - 4.5 * (COORDINATES * 0.8 * 0.2) ** 0.5)
#: Sets of a bucket up to which all pairs are compared at once, and pivots of a larger one.
SMALL, PIVOTS = 16, 2
#: Sets that a block holds, and sets that stream past them.
CHUNK, STREAM = 2048, 8192
#: Throws that are drawn at once, and the lowest id, for rows without one.
THROWS, LOWEST = 1 << 11, -(1 << 63)
UNFILLED = np.uint64((1 << 64) - 1)


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the shingles, ascending; none without words."""
    hashes, total = hashes_of(words, SHINGLE) if words else (iter(()), 0)
    return np.unique(np.fromiter(hashes, dtype="<u8", count=total))


def throws(hashes: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and (round, value) of each hash in each round."""
    x = hashes[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(31))
    drawn = (x >> np.uint64(32)) % np.uint64(COORDINATES)
    bins = np.where(rounds[:, None] < COORDINATES, drawn, rounds[:, None] % np.uint64(COORDINATES))
    return bins.astype(np.int64), rounds[:, None] << np.uint64(32) | x & np.uint64(0xFFFFFFFF)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """16 bits of the least (round, value) of each bin; all zero for the empty set."""
    least = np.full(COORDINATES, UNFILLED)
    at_once = max(1, THROWS // max(1, len(hashes)))
    for first in range(0, 2 * COORDINATES if len(hashes) else 0, at_once):
        rounds = np.arange(first, min(first + at_once, 2 * COORDINATES), dtype=np.uint64)
        for at in range(0, len(hashes), 1 << 16):
            bins, values = throws(hashes[at : at + (1 << 16)], rounds)
            np.minimum.at(least, bins.ravel(), values.ravel())
        if (least != UNFILLED).all():
            break
    return (least if len(hashes) else np.zeros(COORDINATES, dtype=np.uint64)).astype("<u2")


def _profile_batches(batches):
    for batch in batches:
        for start, stop in slices(batch, "text"):
            sets = [shingle_set(words_of(t)) for t in texts_of(batch, "text", start, stop)]
            bands = np.concatenate([sketch(s) for s in sets]).view("<i8")
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(start, stop - start) for c in (0, 1)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(bands)),
                ],
                names=["doc_id", "th", "digest", "size", "bands"],
            )


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, digest, size, bands) of every row: hash of the text, digest, size and band keys of its shingle set."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text")
    return rows.mapInArrow(_profile_batches, "doc_id long, th long, digest binary, size long, bands array<long>")


def distinct_sets(spark: SparkSession, own: DataFrame) -> DataFrame:
    """One node (node, digest, size, bands, component, first) for each distinct set that is not empty.

    ``least`` is its smallest doc_id, ``first`` the row (id, th) whose text stands for it."""
    keyed = own.where("size > 0").withColumn("_row", F.struct(F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), "th"))
    found = keyed.groupBy("digest").agg(F.min("_row").alias("first"), F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    return materialize(spark, found.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")


def _set_batches(batches):
    for batch in batches:
        for start, stop in slices(batch, "text"):
            sets = [shingle_set(words_of(t)).view(np.int64) for t in texts_of(batch, "text", start, stop)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), listed], names=["node", "shingles"])


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of the nodes ``wanted`` (node, first)."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), _text_hash().alias("th"), "text")
    texts = keyed.join(wanted.select("node", "first.id", "first.th"), ["id", "th"])
    return texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_set_batches, "node long, shingles array<long>")


def _fitting(a: Column, b: Column) -> Column:
    """Whether sets of these sizes may be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def agreeing(a: str, b: str) -> Column:
    """In how many bins two sketches, given as band keys, agree."""
    lane = lambda x, k: (F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
    same = F.zip_with(a, b, lambda p, q: sum((lane(p.bitwiseXOR(q), k) for k in range(1, ROWS)), lane(p.bitwiseXOR(q), 0)))
    return F.aggregate(same, F.lit(0), lambda total, n: total + n)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = 100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike).select("a", "b")


class Block(similar.Block):
    """Sets of a bucket, against which its other sets are compared by the bins of their sketches."""

    def __init__(self):
        self.similarity, self.waiting, self.rows, self.linked = PERCENT / 100, [], None, set()

    def _open(self, rows: tuple, at: int) -> np.ndarray:
        _, root, _, size, bins, _ = (x[at : at + similar.CHUNK] for x in rows)
        own = self.rows
        found = (root[:, None] != own[1]) & (100 * np.minimum(size[:, None], own[3]) >= PERCENT * np.maximum(size[:, None], own[3]))
        i, j = np.nonzero(found)
        for k in range(0, len(i), 1 << 15):
            part = slice(k, k + (1 << 15))
            found[i[part], j[part]] = (bins[i[part]] == own[4][j[part]]).sum(axis=1) >= LEAST
        return found


ORDER = ["block", "side"]
LISTED = [*ORDER, "node", "root", "size", "bands"]


def _runs(batch: pa.RecordBatch):
    """(block, side, start, stop, rows) of each run of one block and side."""
    block, side, node, root, size = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
    bins = batch.column(5).flatten().to_numpy(zero_copy_only=False).view("<u2").reshape(len(node), COORDINATES)
    edges = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
    for start, stop in zip([0, *edges], [*edges, len(node)]):
        none = np.zeros(stop - start, dtype=np.int64)
        yield block[start], side[start], start, stop, (node[start:stop], root[start:stop], none, size[start:stop], bins[start:stop], none)


def _mark_batches(batches):
    """Keeps the rows (LISTED, by block, the block's own first) that have a pair to count."""
    block, current, own = None, None, []

    def closing():
        if block is not None and block.rows is not None and block.marked.any():
            yield from pa.Table.from_batches(own).filter(pa.array(block.marked)).to_batches()

    for batch in batches:
        for key, side, start, stop, rows in _runs(batch):
            if key != current:
                yield from closing()
                block, current, own = Block(), key, []
            if side == 0:
                block.add(rows)
                own.append(batch.slice(start, stop - start))
            elif (marked := block.mark(rows)).any():
                yield batch.slice(start, stop - start).filter(pa.array(marked))
    yield from closing()


def _link_batches(batches):
    """Links (u, v) between components that the rows (LISTED and shingles, in the same order) give."""
    block, current = None, None
    for batch in batches:
        lists = batch.column(len(LISTED))
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for key, side, start, stop, rows in _runs(batch):
            if key != current:
                block, current = Block(), key
            sets = [flat[a:b] for a, b in zip(ends[start:stop], ends[start + 1 : stop + 1])]
            if side == 0:
                block.add(rows, sets)
            elif links := block.compare(rows, sets):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])


def finish(spark: SparkSession, docs: DataFrame, nodes: DataFrame, crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """Links (u, v) between components that pairs of one crowded bucket (part, v, node) give.

    One side of a pair that is not connected yet is always outside the bucket's most frequent component, so
    those rows are cut into blocks and all rows of the bucket stream past each: once with their
    sketches, to find the rows that have a pair worth counting, and once more, those alone, with their sets."""
    rooted = crowded.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(spark, rooted.select("part", "v", "node", "root"), "minhash-crowded")
    counts = rooted.groupBy("part", "v", "root").agg(F.count("*").alias("n"))
    spread = counts.groupBy("part", "v").agg(F.max_by("root", F.struct("n", "root")).alias("common"), F.sum("n").alias("n"), F.max("n").alias("most"))
    split = lambda rows, size: F.ceil(rows / size).cast("int")
    spread = spread.where("n > most").select("part", "v", "common", split(F.col("n") - F.col("most"), CHUNK).alias("chunks"), split(F.col("n"), STREAM).alias("streams"))
    open_ = rooted.join(spread, ["part", "v"]).join(nodes.select("node", "size", "bands"), "node")
    number = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = open_.where("root != common").withColumn("chunk", number("chunks")).withColumn("stream", every("streams")).withColumn("side", F.lit(0))
    passing = open_.withColumn("chunk", every("chunks")).withColumn("stream", number("streams")).withColumn("side", F.lit(1))
    ordered = lambda df: df.repartition("block").sortWithinPartitions(*ORDER)
    met = ordered(held.unionByName(passing).withColumn("block", F.xxhash64("part", "v", "chunk", "stream")).select(LISTED))
    worth = materialize(spark, met.mapInArrow(_mark_batches, met.schema), "minhash-worth")
    sets = shingle_sets(docs, nodes.join(worth.select("node").distinct(), "node", "left_semi"))
    listed = ordered(worth.join(sets, "node").select(*LISTED, "shingles"))
    out = materialize(spark, listed.mapInArrow(_link_batches, "u long, v long").distinct(), "minhash-more")
    discard(spark, worth)
    discard(spark, rooted)
    return out


def links(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(v, root) as :func:`simhash.components` gives it, for the links between ``nodes``."""
    listed = nodes.select("node", "size", F.posexplode("bands").alias("part", "v"))
    sizes = listed.groupBy("part", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(spark, listed.join(sizes, ["part", "v"]), "minhash-buckets")
    small = F.col("n") <= SMALL
    order = Window.partitionBy("part", "v").orderBy(F.xxhash64("node"), "node")
    pivots = shared.where(~small).withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).drop("r")
    of = lambda df, side: df.select("part", "v", F.col("node").alias(side), F.col("size").alias(f"n{side}"))
    fitting = _fitting(F.col("na"), F.col("nb"))
    pairs = of(shared.where(small), "a").join(of(shared.where(small), "b"), ["part", "v"]).where(fitting & (F.col("a") < F.col("b")))
    starred = of(pivots, "a").join(of(shared.where(~small), "b"), ["part", "v"]).where(fitting & (F.col("a") != F.col("b")))
    met = pairs.unionByName(starred).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bands = lambda side: nodes.select(F.col("node").alias(side), F.col("bands").alias(f"b{side}"))
    near = met.join(bands("a"), "a").join(bands("b"), "b").where(agreeing("ba", "bb") >= LEAST)
    first = materialize(spark, near.select("a", "b"), "minhash-pairs")
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(spark, shingle_sets(docs, nodes.join(wanted, "node", "left_semi")), "minhash-sets")
    edges = materialize(spark, verified(first, sets).select(F.col("a").alias("u"), F.col("b").alias("v")), "minhash-edges")
    for used in (first, sets):
        discard(spark, used)
    roots = components(spark, edges)
    more = finish(spark, docs, nodes, shared.where(~small), roots)
    out = roots if more.isEmpty() else components(spark, roots.select(F.col("root").alias("u"), "v").unionByName(more))
    for used in (shared, edges, more):
        discard(spark, used)
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    own = materialize(spark, profiles(docs), "minhash-profiles")
    nodes = distinct_sets(spark, own)
    named = nodes.join(links(spark, docs, nodes).withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("digest", "component_id")
    rows = own.where("size > 0").join(found, "digest").select("doc_id", "size", "component_id")
    rows = rows.unionByName(own.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    kept = F.col("component_id").eqNullSafe(F.col("doc_id"))
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "component_id", kept.alias("kept"))


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs)
