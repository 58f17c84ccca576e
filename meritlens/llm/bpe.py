"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are cut into pieces by the tokenizer's pattern.  Distinct pieces of a batch are encoded
once: pieces of like byte length form one padded matrix of token ids, and in each round every row
merges its leftmost pair of least rank.  Pairs are looked up in an open-addressing hash table; the
rows are compacted after each merge, and finished rows leave the matrix.

A piece of over ``LONG`` bytes is a row of its own, whose ids are linked instead of compacted and whose pairs
wait by rank, so that its cost grows with its merges.  A round merges every occurrence of the least
rank, leftmost first.  The ids are the same as long as the merged id is part of no pair of lower rank; for the
few ids that are (``fickle``), a round ends with the first occurrence that gives such a pair.

Edge cases: null text counts as empty and encodes to no ids; repeated texts give equal rows; very long
texts are encoded whole; pairs of one rank go leftmost first, and no other ties arise; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import slices, texts_of

#: Bytes of a piece up to which it shares a matrix with others.
LONG = 128
#: Distinct pieces whose ids a Python worker remembers between batches.
MEMORY = 400_000
NONE = np.int64(1) << 40


def _mix(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id, which is its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(len(left) * 4).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, dtype=np.int64)
        self.values = np.full(size, NONE, dtype=np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slot, todo = (_mix(keys) & self.mask).astype(np.int64), np.arange(len(keys))
        self.steps = 0
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several, the last stays
            held = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[held]]] = merged[todo[held]]
            todo = todo[~held]
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            self.steps += 1

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slot = (_mix(keys) & self.mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.steps):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & int(self.mask)
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


class ByteBPE:
    """A byte-level BPE vocabulary given by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[t[:k]], ranks[t[k:]], i)
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        left, right, merged = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.fickle = np.zeros(int(merged.max(initial=255)) + 1, dtype=bool)
        for part in (left, right):
            self.fickle[part[merged < part]] = True
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        ordered = [self.tokens[i] if i in self.tokens else b"" for i in range(max(self.tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(ordered), dtype=np.uint8)
        self.token_ends = np.cumsum([len(t) for t in ordered])
        self.token_sizes = np.array([len(t) for t in ordered], dtype=np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Encode the rows of a padded matrix; row i has sizes[i] ids."""
        out: list[np.ndarray] = [rows[:0, 0]] * len(rows)
        place = np.arange(len(rows))
        rank = self.pairs.find(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        rank[np.arange(1, rows.shape[1]) >= sizes[:, None]] = NONE
        while len(rows):
            live = rank.shape[1] > 0
            at = rank.argmin(axis=1) if live else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if live else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[place[i]] = rows[i, : sizes[i]].copy()
                go = ~done
                rows, rank, sizes, place, at, least = rows[go], rank[go], sizes[go], place[go], at[go], least[go]
                if not len(rows):
                    break
            width = int(sizes.max())
            rows, rank = rows[:, :width], rank[:, : width - 1]
            every = np.arange(len(rows))
            # compaction: what stands right of the merged pair moves one place to the left
            columns = np.arange(width - 1)
            source = columns + (columns > at[:, None])
            rows = np.take_along_axis(rows, source, axis=1)
            rows[every, at] = least
            sizes = sizes - 1
            if width > 2:
                source = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2)
                rank = np.take_along_axis(rank, source, axis=1)
                for shift in (-1, 0):
                    j = at + shift
                    ok = (j >= 0) & (j + 1 < sizes)
                    r, c = every[ok], j[ok]
                    rank[r, c] = self.pairs.find(rows[r, c], rows[r, c + 1])
                rank[np.arange(1, width - 1) >= sizes[:, None]] = NONE
            else:
                rank = rank[:, :0]
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a row whose ids are linked, so that a round costs what it merges.

        Pairs wait by rank; a round takes those of the least rank, leftmost first, and only pairs that
        it has changed are looked up again."""
        n = len(piece)
        ids = np.append(self.byte_ids[np.frombuffer(piece, dtype=np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, NONE)
        rank[: n - 1] = self.pairs.find(ids[: n - 1], ids[1:n])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            ranks = rank[at]
            edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
            for start, stop in zip(edges, edges[1:]):
                if start < stop:
                    if (r := int(ranks[start])) not in waiting:
                        waiting[r] = []
                        heappush(heap, r)
                    waiting[r].append(at[start:stop])

        wait(np.arange(n - 1))
        while heap:
            least = heappop(heap)
            every = np.unique(np.concatenate(waiting.pop(least)))
            every = every[rank[every] == least]
            at = self._apart(every, after)
            if self.fickle[least] and len(at) > 1:
                at = self._until_lower(at, least, ids, after, before)
                wait(every[every > at[-1]])
            gone = after[at]
            ids[at], rank[gone] = least, NONE
            after[at] = following = after[gone]
            before[following] = at
            left = before[at]
            changed = np.concatenate([left[left >= 0], at[following < n]])
            rank[at[following >= n]] = NONE
            rank[changed] = self.pairs.find(ids[changed], ids[after[changed]])
            ids[gone] = -1
            wait(changed)
        return ids[ids >= 0]

    @staticmethod
    def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a run, every other one from its left end."""
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = at[1:] != after[at[:-1]]
        if begins.all():
            return at
        place = np.arange(len(at))
        return at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]

    def _until_lower(self, at: np.ndarray, least: int, ids: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The merges up to the first one that gives a pair of lower rank, which then comes next."""
        following = after[after[at]]
        left = ids[before[at]]  # at the left end this is the mark behind the right end, -1
        left[1:][following[:-1] == at[1:]] = least
        new = np.minimum(self.pairs.find(left, np.full(len(at), least)), self.pairs.find(np.full(len(at), least), ids[following]))
        low = np.flatnonzero(new < least)
        return at[: low[0] + 1] if len(low) else at

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole])
            elif len(p) > LONG:
                out[i] = self._merge_long(p)
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in todo], dtype=np.int64)
        start = 0
        while start < len(todo):
            top = max(4, int(lengths[start]) * 5 // 4)
            stop = min(int(np.searchsorted(lengths, top, side="right")), start + max(1, 200_000 // top))
            sizes = lengths[start:stop]
            data = np.frombuffer(b"".join(pieces[i] for i in todo[start:stop]), dtype=np.uint8)
            rows = np.full((stop - start, int(sizes[-1])), 0, dtype=np.int64)
            rows[np.arange(rows.shape[1]) < sizes[:, None]] = self.byte_ids[data]
            for i, ids in zip(todo[start:stop], self._merge_rows(rows, sizes)):
                out[i] = ids
            start = stop
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of new pieces to what the worker remembers."""
        ids = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in pieces])
        base = len(self.known)
        for k, p in enumerate(pieces):
            self.known[p] = base + k
        ends = np.cumsum([len(x) for x in ids], dtype=np.int64) + self.bounds[base]
        while len(self.bounds) <= base + len(ids):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.bounds[base] : ends[-1]] = np.concatenate(ids)
        self.bounds[base + 1 : base + 1 + len(ids)] = ends

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(self.known) > MEMORY:
            self.known.clear()
        cut = [self.pattern.findall(t) for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        if new:
            self._learn(list(new))
        out = []
        for pieces in cut:
            k = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            starts, sizes = self.bounds[k], self.bounds[k + 1] - self.bounds[k]
            out.append(gather(self.flat, starts, sizes))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        k = ids.astype(np.int64)
        sizes = self.token_sizes[k]
        return gather(self.token_bytes, self.token_ends[k] - sizes, sizes).tobytes()


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of flat[starts[i] : starts[i] + sizes[i]]."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[np.arange(total) + shift]


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE.from_file(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; ids is the little-endian 32-bit form of the token ids."""

    def run(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            for start, stop in slices(batch, "text", 2 << 20):
                ids = bpe.encode_texts(texts_of(batch, "text", start, stop))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["doc_id", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (bytes) to rows of (doc_id, ids)."""

    def run(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.frombuffer(x.as_py(), dtype="<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op5(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digest of ids and of what they decode to."""

    def run(batches):
        bpe = _loaded(path, pattern)
        for batch in batches:
            for start, stop in slices(batch, "text", 2 << 20):
                ids = bpe.encode_texts(texts_of(batch, "text", start, stop))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
