"""Groups of near copies: SimHash candidates by the generalised pigeonhole, verified on shingle sets.

Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 or more;
groups are the connected components of these links.

1. Each distinct shingle set gets WORDS words of 64 SimHash bits and the list of its least sure bits,
   those an edit flips.  Texts with one set are one node.
2. In each word correlated bits share a partition (2, 3 or 4 partitions a word).  A dynamic programme
   picks the layout of each word and an own threshold for each partition: how many of its least sure
   bits a fingerprint flips when it probes.  Costs are candidate counts estimated from all
   fingerprints; the constraint is that a pair at the similarity is met with probability GOAL.
3. Every fingerprint is indexed under its partition values and probes the values its flips give.
   Candidates that are near in all bits are verified by exact counts on the sets.

Buckets over SMALL rows are not compared pair by pair at once: each row first meets PIVOTS others,
which connects nearly all of a group of copies.  Then all pairs of each such bucket that are not
connected yet are compared, in blocks of bounded size, each pair in the first bucket where it meets;
blocks give only links between components, so nothing grows with the pairs of a group and no pair is
left out.

Edge cases: texts without words (null or empty, too) have the empty set and are one group; texts of
fewer than five words have one shingle; repeated rows and rows that share a doc_id are judged by their
texts; rows without a doc_id belong to no group and are kept; very long texts are hashed in blocks; ties
of doc_id in a group go by the hash of the text; an empty table gives an empty result; further columns
are carried along untouched, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.llm.common import discard, materialize, slices, texts_of
from meritlens.llm.simhash import BLOCK, arrange, bit_statistics, components, hashes_of, mask_of, ones, packed, words_of

#: Similarity of 5-word shingle sets that near copies have.
SIMILARITY, SHINGLE = 0.8, 5
#: 64-bit words of a fingerprint, and how many of its least sure bits are kept.
WORDS, SOFT = 6, 128
PRINTS, FLIPS = [f"p{k}" for k in range(WORDS)], [f"f{k}" for k in range(WORDS)]
#: Chance of meeting a pair at the similarity that the plan must reach, and steps of its logarithm.
GOAL, STEP = 0.95, 0.02
#: Partitions that a word may be cut into, and most bits flipped in one.
LAYOUTS, MOST = (2, 3, 4), 5
#: Cost of a listed row, and of one in a crowded bucket, in pairs compared.
ROW, CROWDED = 20.0, 400.0
#: Deviations of the fingerprints' distance within which pairs go on, for the first word and for all.
SLACK = 4
#: Rows of a bucket up to which all pairs are compared at once, and pivots of a larger one.
SMALL, PIVOTS = 32, 2
#: Rows of a crowded bucket that a block holds, and rows that stream past them.
CHUNK, STREAM = 256, 4096


def check_distance(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of sets this similar differ: the expected number and SLACK deviations."""
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * angle + SLACK * np.sqrt(bits * angle * (1 - angle)))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of the shingles of SHINGLE words, ascending; none without words."""
    hashes, total = hashes_of(words, SHINGLE) if words else (iter(()), 0)
    return np.unique(np.fromiter(hashes, dtype="<u8", count=total))


def profile(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint words of a shingle set and its SOFT least sure bits, least sure first."""
    counts = np.zeros((WORDS, 64), dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        for k in range(WORDS):
            if k:  # the finaliser of splitmix64
                block = block + np.uint64(0x9E3779B97F4A7C15)
                block = (block ^ (block >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                block = (block ^ (block >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                block = block ^ (block >> np.uint64(31))
            counts[k] += ones(block)
    flat = counts.ravel()
    unsure = np.argsort(np.abs(2 * flat - len(hashes)), kind="stable")[:SOFT]
    return packed(flat, len(hashes)), unsure.astype("<u2")


def _profile_batches(batches):
    for batch in batches:
        for start, stop in slices(batch, "text"):
            sets = [shingle_set(words_of(t)) for t in texts_of(batch, "text", start, stop)]
            found = [profile(s) for s in sets]
            prints = np.array([p for p, _ in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(start, stop - start) for c in (0, 1)),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                    *(pa.array(prints[:, k]) for k in range(WORDS)),
                    pa.array([u.tobytes() for _, u in found], pa.binary()),
                ],
                names=["doc_id", "th", "digest", "size", *PRINTS, "soft"],
            )


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, th, digest, size, p0.., soft) of every row: hash of the text, digest and size of its
    shingle set, fingerprint words, least sure bits."""
    schema = "doc_id long, th long, digest binary, size long, " + ", ".join(f"{p} long" for p in PRINTS) + ", soft binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text").mapInArrow(_profile_batches, schema)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def distinct_sets(spark: SparkSession, own: DataFrame) -> DataFrame:
    """One node (node, size, p0.., soft, first) for each distinct shingle set of ``own``.

    ``node`` is a 64-bit hash of the set's digest, drawn anew in the unlikely case that two sets share
    one; ``first`` is the least (doc_id, th)."""
    salt = 0
    while True:
        rest = [F.first(c).alias(c) for c in ("size", *PRINTS, "soft")]
        found = own.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("first"), *rest)
        found = materialize(spark, found.select(F.xxhash64("digest", F.lit(salt)).alias("node"), "first", "size", *PRINTS, "soft"), "similar-nodes")
        if found.groupBy("node").count().where("count > 1").isEmpty():
            return found
        discard(spark, found)
        salt += 1


@lru_cache
def success(width: int, similarity: float) -> tuple[float, ...]:
    """Chance that a partition of ``width`` bits meets a pair at the similarity, for 0..MOST flips on either side.

    Bit sums of large sets are nearly normal, with the sets' cosine as correlation; a fixed seed
    makes the estimate the same everywhere."""
    cosine = 2 * similarity / (1 + similarity)
    rng = np.random.default_rng(width)
    x = rng.standard_normal((4000, width))
    y = cosine * x + np.sqrt(1 - cosine**2) * rng.standard_normal(x.shape)
    flipped = (x > 0) != (y > 0)
    ranked = [np.take_along_axis(flipped, np.argsort(np.abs(m), axis=1), 1) for m in (x, y)]
    return tuple(float((~ranked[0][:, t:].any(1) | ~ranked[1][:, t:].any(1)).mean()) for t in range(MOST + 1))


def word_choices(parts: list[tuple[list[int], list[float], tuple[float, ...]]], limit: int) -> dict[int, tuple[float, list[int]]]:
    """Least cost, with thresholds (-1: unused), of each gain in STEPs that one word's partitions can give.

    A part is (bits, costs of 0.. flips, chances of 0.. flips); gain is -log of the chance to miss."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for _, costs, chances in parts:
        options = [(0, 0.0, -1)]
        options += [(int(-np.log1p(-min(p, 0.999)) / STEP), c, t) for t, (c, p) in enumerate(zip(costs, chances))]
        step: dict[int, tuple[float, list[int]]] = {}
        for had, (cost, chosen) in best.items():
            for gain, more, t in options:
                key, found = min(limit, had + gain), (cost + more, [*chosen, t])
                if key not in step or found < step[key]:
                    step[key] = found
        best = step
    return best


def allocate(words: list[dict[int, tuple[float, tuple]]], limit: int) -> list[tuple]:
    """One choice for each word so that gains add up to ``limit`` at the least cost, or the most gain there is."""
    best: dict[int, tuple[float, list[tuple]]] = {0: (0.0, [])}
    for options in words:
        step: dict[int, tuple[float, list[tuple]]] = {}
        for had, (cost, chosen) in best.items():
            for gain, (more, choice) in options.items():
                key, found = min(limit, had + gain), (cost + more, [*chosen, choice])
                if key not in step or found[0] < step[key][0]:
                    step[key] = found
        best = step
    return best[max(best)][1]


def plan(nodes: DataFrame, similarity: float = SIMILARITY) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) of each partition in use.

    Rows that share a value are counted over all fingerprints for the partitions of the first word; other
    words are mixes of the same hashes, and their counts follow from how even their bits are."""
    shares, correlations, _ = bit_statistics(nodes, PRINTS)
    layouts = {(k, m): arrange(correlations[k], m) for k in range(WORDS) for m in LAYOUTS}
    first = [(m, i, bits) for m in LAYOUTS for i, bits in enumerate(layouts[0, m])]
    keys = F.array(*(F.struct(F.lit(j).alias("part"), F.col("p0").bitwiseAND(F.lit(mask_of(b))).alias("v")) for j, (_, _, b) in enumerate(first)))
    counted = nodes.select(F.explode(keys).alias("k")).groupBy("k.part", "k.v").agg(F.count("*").alias("n"))
    held = counted.groupBy("part", F.least("n", F.lit(SMALL + 1)).alias("n")).agg(F.sum("n").alias("rows")).collect()

    def cost(place: tuple[int, int], scale: float, t: int) -> float:
        """Of the partition at ``place`` of a layout, with t flips: listed rows, and pairs while buckets are small."""
        each = [(r.rows, scale * r.n * 2**t) for r in held if first[r.part][:2] == place]
        return 2**t * sum(rows * (ROW + (n if n <= SMALL else CROWDED)) for rows, n in each)

    def chance(k: int, bits: list[int]) -> float:
        """How likely two fingerprints agree in these bits if they were independent."""
        p = shares[k][bits]
        return float(np.prod(p**2 + (1 - p) ** 2))

    limit = int(np.ceil(-np.log1p(-GOAL) / STEP))
    words = []
    for k in range(WORDS):
        options: dict[int, tuple[float, tuple]] = {}
        for m in LAYOUTS:
            parts = []
            for i, bits in enumerate(layouts[k, m]):
                scale = chance(k, bits) / chance(0, layouts[0, m][i])
                parts.append((bits, [cost((m, i), scale, t) for t in range(MOST + 1)], success(len(bits), similarity)))
            for gain, (total, chosen) in word_choices(parts, limit).items():
                if gain not in options or total < options[gain][0]:
                    options[gain] = (total, tuple((k, bits, t) for (bits, _, _), t in zip(parts, chosen) if t >= 0))
        words.append(options)
    return [part for choice in allocate(words, limit) for part in choice]


def flips_of(soft: np.ndarray, parts: list[tuple[int, list[int], int]]) -> list[list[np.ndarray]]:
    """For each partition the masks of the bits that rows flip in it, least sure first (0: no more)."""
    everyone, out = np.arange(len(soft)), []
    for word, bits, most in parts:
        member = np.zeros(64 * WORDS, dtype=bool)
        member[[64 * word + b for b in bits]] = True
        rank = np.cumsum(member[soft], axis=1)
        own = []
        for t in range(1, most + 1):
            bit = np.uint64(1) << (soft[everyone, (rank >= t).argmax(axis=1)] & 63).astype(np.uint64)
            own.append(np.where(rank[:, -1] >= t, bit, np.uint64(0)))
        out.append(own)
    return out


def keys_of(prints: np.ndarray, soft: np.ndarray, parts: list[tuple[int, list[int], int]]):
    """(part, rows, values, probe) in turn: the values under which rows look in a partition; those with
    probe 0 are also where they are indexed.  ``prints`` is rows x WORDS, ``soft`` rows x SOFT."""
    for number, ((word, bits, most), flips) in enumerate(zip(parts, flips_of(soft, parts))):
        own = prints[:, word] & np.uint64(mask_of(bits) % (1 << 64))
        for subset in range(1 << most):
            value, rows = own.copy(), np.ones(len(own), dtype=bool)
            for t in range(most):
                if subset >> t & 1:
                    value ^= flips[t]
                    rows &= flips[t] != 0
            rows = np.flatnonzero(rows)
            yield number, rows, value[rows], int(subset > 0)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, fingerprints and least sure bits of a batch (node, p0.., soft, ...)."""
    prints = np.stack([batch.column(1 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(WORDS)], axis=1)
    soft = np.frombuffer(b"".join(batch.column(1 + WORDS).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(zero_copy_only=False), prints, soft


def with_flips(nodes: DataFrame, parts: list[tuple[int, list[int], int]]) -> DataFrame:
    """(node, size, p0.., f0..): the bits that a node flips, in all partitions together, instead of its least sure ones."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                _, _, soft = _columns(batch)
                masks = np.zeros((batch.num_rows, WORDS), dtype=np.uint64)
                for (word, _, _), flips in zip(parts, flips_of(soft, parts)):
                    for f in flips:
                        masks[:, word] |= f
                kept = [batch.column(0), batch.column(2 + WORDS), *(batch.column(1 + k) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(np.ascontiguousarray(masks[:, k]).view(np.int64)) for k in range(WORDS))], names=["node", "size", *PRINTS, *FLIPS]
                )

    longs = ", ".join(f"{c} long" for c in (*PRINTS, *FLIPS))
    return nodes.select("node", *PRINTS, "soft", "size").mapInArrow(run, f"node long, size long, {longs}")


def listed_keys(nodes: DataFrame, parts: list[tuple[int, list[int], int]]) -> DataFrame:
    """(part, v, d, node, other): every node under each value it is indexed under (d = 0) or probes.

    ``other`` is a word that the partition does not cut, by which candidates are sifted."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                node, prints, soft = _columns(whole.slice(at, 1024))
                for number, rows, values, probe in keys_of(prints, soft, parts):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(rows), number, dtype=np.int32)),
                                pa.array(values.view(np.int64)),
                                pa.array(np.full(len(rows), probe, dtype=np.int32)),
                                pa.array(node[rows]),
                                pa.array(prints[rows, (parts[number][0] + 1) % WORDS].view(np.int64)),
                            ],
                            names=["part", "v", "d", "node", "other"],
                        )

    return nodes.where("size > 0").select("node", *PRINTS, "soft").mapInArrow(run, "part int, v long, d int, node long, other long")


def _set_batches(batches):
    for batch in batches:
        for start, stop in slices(batch, "text"):
            sets = [shingle_set(words_of(t)).view(np.int64) for t in texts_of(batch, "text", start, stop)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), listed], names=["node", "shingles"])


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the distinct shingle hashes of the nodes ``wanted`` (node, first)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), "text")
    texts = keyed.join(wanted.select("node", "first.doc_id", "first.th"), ["doc_id", "th"])
    return texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_set_batches, "node long, shingles array<long>")


def _apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{p}{a}").bitwiseXOR(F.col(f"{p}{b}"))) for p in PRINTS), F.lit(0))


def _worth(similarity: float) -> Column:
    """Whether a pair of nodes a, b may be similar enough: by sizes, exactly, and by all bits with slack."""
    sizes = F.least("sizea", "sizeb") >= similarity * F.greatest("sizea", "sizeb")
    return sizes & (_apart("a", "b") <= check_distance(similarity, 64 * WORDS))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, by exact counts."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"))
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / F.greatest(F.size("sa") + F.size("sb") - both, F.lit(1)) >= similarity
    return pairs.join(of("a"), "a").join(of("b"), "b").where(alike).select("a", "b")


class Block:
    """At most about CHUNK rows of a bucket, against which its other rows are compared.

    Rows are (node, root, d, size, prints, flips) as arrays and, for exact counts, a list of sets."""

    def __init__(self, key: tuple, parts: list[tuple[int, int]], similarity: float):
        self.part, self.value = int(key[0]), np.int64(key[1]).view(np.uint64)
        self.parts, self.similarity, self.limit = parts, similarity, check_distance(similarity, 64 * WORDS)
        self.waiting: list[tuple] = []
        self.rows: tuple | None = None
        self.linked: set[tuple[int, int]] = set()

    def add(self, rows: tuple, sets: list | None = None) -> None:
        self.waiting.append((*rows, sets))

    def close(self) -> bool:
        if self.waiting:
            self.rows = tuple(np.concatenate([w[k] for w in self.waiting]) for k in range(6))
            self.marked = np.zeros(len(self.rows[0]), dtype=bool)
            if self.waiting[0][6] is not None:
                sets = [s for w in self.waiting for s in w[6]]
                tokens = np.concatenate(sets)
                order = np.argsort(tokens, kind="stable")
                self.tokens = tokens[order]
                self.owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
            self.waiting = []
        return self.rows is not None

    def _first_meeting(self, a: tuple, b: tuple) -> np.ndarray:
        """Whether each pair of rows (aligned arrays) has not met in a bucket before this one.

        Rows meet in a partition if the bits in which they differ there are all flipped by one of them:
        under the other's value, or, if both flip them, under both values; then that of the lesser node counts."""
        (node_a, _, _, _, print_a, flip_a), (node_b, _, _, _, print_b, flip_b) = a, b
        fresh = np.ones(len(node_a), dtype=bool)
        for number, (word, mask) in enumerate(self.parts[: self.part + 1]):
            apart = (print_a[:, word] ^ print_b[:, word]) & np.uint64(mask)
            by_a, by_b = apart & ~flip_a[:, word] == 0, apart & ~flip_b[:, word] == 0
            if number < self.part:
                fresh &= ~(by_a | by_b)
            else:
                own = np.where(by_a & (~by_b | (node_b < node_a)), print_b[:, word], print_a[:, word]) & np.uint64(mask)
                fresh &= (by_a | by_b) & (own == self.value)
        return fresh

    def _open(self, rows: tuple, at: int) -> np.ndarray:
        """Pairs of up to CHUNK rows from ``at`` with the block's that remain to be compared."""
        node, root, d, size, prints, flips = (x[at : at + CHUNK] for x in rows)
        own = self.rows
        found = (root[:, None] != own[1]) & ((d[:, None] == 0) | (own[2] == 0))
        found &= np.minimum(size[:, None], own[3]) >= self.similarity * np.maximum(size[:, None], own[3])
        apart = sum(np.bitwise_count(prints[:, None, k] ^ own[4][None, :, k]).astype(np.int16) for k in range(WORDS))
        found &= apart <= self.limit
        i, j = np.nonzero(found)
        found[i, j] = self._first_meeting(tuple(x[i] for x in (node, root, d, size, prints, flips)), tuple(x[j] for x in own))
        return found

    def mark(self, rows: tuple) -> np.ndarray:
        """Which of the rows have a pair to compare; those of the block are noted in ``marked``."""
        out = np.zeros(len(rows[0]), dtype=bool)
        if self.close():
            for at in range(0, len(out), CHUNK):
                open_ = self._open(rows, at)
                out[at : at + CHUNK] = open_.any(axis=1)
                self.marked |= open_.any(axis=0)
        return out

    def compare(self, rows: tuple, sets: list) -> list[tuple[int, int]]:
        """New links between components (root, root) that the rows give."""
        found: list[tuple[int, int]] = []
        if not self.close():
            return found
        root, size = rows[1], rows[3]
        for at in range(0, len(root), CHUNK):
            open_ = self._open(rows, at)
            for i in np.flatnonzero(open_.any(axis=1)):
                own = sets[at + i]
                low, high = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
                hits = high - low
                place = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
                both = np.bincount(self.owner[place], minlength=len(self.rows[0]))
                alike = open_[i] & (both / np.maximum(self.rows[3] + size[at + i] - both, 1) >= self.similarity)
                for other in np.unique(self.rows[1][alike]).tolist():
                    link = (min(other, int(root[at + i])), max(other, int(root[at + i])))
                    if link not in self.linked:
                        self.linked.add(link)
                        found.append(link)
        return found


KEY = ["part", "v", "chunk", "stream"]
ROWS = [*KEY, "side", "node", "root", "d", "size", *PRINTS, *FLIPS]


def _runs(batch: pa.RecordBatch):
    """(key, side, start, stop, rows) of each run of one block and side in a batch of ROWS."""
    numbers = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(ROWS))]
    keys = np.stack(numbers[:5], axis=1)
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    for start, stop in zip([0, *edges], [*edges, len(keys)]):
        node, root, d, size, *bits = (x[start:stop] for x in numbers[5:])
        stacked = np.stack(bits, axis=1).view(np.uint64)
        yield tuple(keys[start, :4]), keys[start, 4], start, stop, (node, root, d, size, stacked[:, :WORDS], stacked[:, WORDS:])


def _mark_batches(parts: list[tuple[int, int]], similarity: float):
    """Keeps the rows (ROWS, by block, the block's own first) that have a pair to compare."""

    def run(batches):
        block, current, own = None, None, []

        def closing():
            if block is not None and block.rows is not None and block.marked.any():
                held = pa.Table.from_batches(own)
                yield from held.filter(pa.array(block.marked)).to_batches()

        for batch in batches:
            for key, side, start, stop, rows in _runs(batch):
                if key != current:
                    yield from closing()
                    block, current, own = Block(key, parts, similarity), key, []
                if side == 0:
                    block.add(rows)
                    own.append(batch.slice(start, stop - start))
                elif (marked := block.mark(rows)).any():
                    yield batch.slice(start, stop - start).filter(pa.array(marked))
        yield from closing()

    return run


def _block_batches(parts: list[tuple[int, int]], similarity: float):
    """Links (u, v) between components that the rows (ROWS and shingles, in the same order) give."""

    def run(batches):
        block, current = None, None
        for batch in batches:
            lists = batch.column(len(ROWS))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for key, side, start, stop, rows in _runs(batch):
                if key != current:
                    block, current = Block(key, parts, similarity), key
                sets = [flat[a:b] for a, b in zip(ends[start:stop], ends[start + 1 : stop + 1])]
                if side == 0:
                    block.add(rows, sets)
                elif links := block.compare(rows, sets):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])

    return run


def finish(spark: SparkSession, rows: DataFrame, sets: DataFrame, parts: list[tuple[int, list[int], int]], similarity: float) -> DataFrame:
    """Links (u, v) between components that pairs of one bucket give, for buckets of ``rows``
    (part, v, d, node, root, size, p0.., f0..) that hold several.

    One side of a pair that is not connected yet is always outside the bucket's most frequent
    component, so those rows are cut into chunks and all rows of the bucket stream past each: once to find
    the rows that have a pair worth counting, and once more, those alone, with their sets."""
    masks = [(word, mask_of(bits) % (1 << 64)) for word, bits, _ in parts]
    counts = rows.groupBy("part", "v", "root").agg(F.count("*").alias("n"))
    common = counts.groupBy("part", "v").agg(
        F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("others")
    )
    split = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    common = common.where("others > 0").select("part", "v", F.col("x.root").alias("common"), split("others", CHUNK).alias("chunks"), split("n", STREAM).alias("streams"))
    open_ = rows.join(common, ["part", "v"])
    number = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    held = open_.where("root != common").withColumn("chunk", number("chunks")).withColumn("stream", every("streams")).withColumn("side", F.lit(0))
    passing = open_.withColumn("chunk", every("chunks")).withColumn("stream", number("streams")).withColumn("side", F.lit(1))
    ordered = lambda df: df.repartition(*KEY).sortWithinPartitions(*KEY, "side")
    met = ordered(held.unionByName(passing).select(ROWS))
    worth = materialize(spark, met.mapInArrow(_mark_batches(masks, similarity), met.schema), "similar-worth")
    listed = ordered(worth.join(sets, "node").select(*ROWS, "shingles"))
    out = materialize(spark, listed.mapInArrow(_block_batches(masks, similarity), "u long, v long").distinct(), "similar-more")
    discard(spark, worth)
    return out


def links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(v, root) as :func:`simhash.components` gives it, for the links between ``nodes``."""
    parts = plan(nodes, similarity)
    listed = listed_keys(nodes, parts)
    sizes = listed.groupBy("part", "v").agg(F.count("*").alias("n"), F.count_if(F.col("d") == 0).alias("n0")).where("n > 1 and n0 > 0")
    shared = materialize(spark, listed.join(sizes.drop("n0"), ["part", "v"]), "similar-buckets")
    small = F.col("n") <= SMALL
    index = shared.where("d = 0")
    order = Window.partitionBy("part", "v").orderBy(F.xxhash64("node"), "node")
    pivots = index.where(~small).withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).drop("r")
    a = index.where(small).unionByName(pivots).select("part", "v", F.col("other").alias("pa"), F.col("node").alias("a"))
    b = shared.select("part", "v", F.col("other").alias("pb"), F.col("node").alias("b"))
    near = F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= check_distance(similarity, 64)
    met = a.join(b, ["part", "v"]).where(near & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of = lambda side: nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}{side}") for c in ("size", *PRINTS)))
    first = materialize(spark, met.join(of("a"), "a").join(of("b"), "b").where(_worth(similarity)).select("a", "b"), "similar-pairs")
    crowded = shared.where(~small)
    wanted = first.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    sets = materialize(spark, shingle_sets(docs, nodes.select("node", "first").join(wanted, "node", "left_semi")), "similar-sets")
    edges = materialize(spark, verified(first, sets, similarity).select(F.col("a").alias("u"), F.col("b").alias("v")), "similar-edges")
    roots = components(spark, edges)
    rooted = with_flips(nodes, parts).join(roots.withColumnRenamed("v", "node"), "node", "left")
    named = rooted.select("node", F.coalesce("root", "node").alias("root"), "size", *PRINTS, *FLIPS)
    rows = materialize(spark, crowded.select("part", "v", "d", "node").join(named, "node"), "similar-crowded")
    more = finish(spark, rows, sets, parts, similarity)
    whole = roots.select(F.col("root").alias("u"), "v").unionByName(more)
    out = roots if more.isEmpty() else components(spark, whole)
    for used in (shared, first, sets, edges, rows, more):
        discard(spark, used)
    return out


def grouped(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, digest, ...) that have a doc_id, and nodes with the ``root`` of their group."""
    own = materialize(spark, profiles(docs.where("doc_id is not null")), "similar-profiles")
    nodes = distinct_sets(spark, own)
    roots = links(spark, docs, nodes, similarity)
    return own, nodes.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_groups(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: the smallest doc_id of its group."""
    own, nodes = grouped(spark, docs, similarity)
    least = nodes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = nodes.join(least, "root").select("first", "component_id")
    rows = own.join(own.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("first")), "digest")
    return rows.select("doc_id", "first").join(named, "first").select("doc_id", "component_id")


def one_per_group(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group, that with the least (doc_id, hash of the text); rows without a doc_id stay.

    Rows that agree in both are copies of one text under one id: one of them stays, whichever."""
    _, nodes = grouped(spark, docs, similarity)
    keep = nodes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_doc"), F.col("first.th").alias("_th"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), _text_hash().alias("_th"))
    named = keyed.join(keep, ["_doc", "_th"], "left_semi").dropDuplicates(["_doc", "_th"])
    return named.select("_row.*").unionByName(docs.where("doc_id is null"))
