"""Packing by concatenate and cut.

Pass 1 tokenises every document once and writes (partition, start in the partition, ids) to the
shared folder.  The partitions' token totals, one number each, are prefix-summed into global
offsets.  Pass 2 reads the table back and cuts the endless stream of ids at multiples of the
sequence length; a document that crosses a cut yields one boundary record per sequence it touches.
No rows are shuffled.

Texts go to the tokenizer in chunks that start at a single space between two non-space
characters.  The byte-level pre-tokenizer always cuts there, whatever stands on either side, so a
chunk's ids do not depend on its neighbours, and each worker encodes a distinct chunk once.  Chunks are
found again by hash and then compared byte by byte, so texts whose hashes collide keep their own ids.

All sequences are full but the last, which is padded to ``length`` unless it holds a power of two
of tokens.

Edge cases: null text counts as empty and gives one separator; repeated rows are packed as often
as they occur; rows that share a doc_id, or have none, are documents of their own; very long texts are
encoded a window at a time and span as many sequences as they need; the order of documents is that of the
scan and ties nothing to their ids; an empty table gives no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.llm.bpe import gather
from meritlens.llm.common import materialize, slices, texts_of

LENGTH = 1024
SEPARATOR = 0
#: Slots of a worker's chunk table (a power of two); it starts anew when half full, or when its chunks
#: hold so many bytes.
SLOTS, HELD = 1 << 21, 48 << 20
#: New chunks that go to the tokenizer as one text.
TOGETHER = 64
#: Bytes that are looked at together; longer texts are encoded in parts.
WINDOW = 2 << 20


def _white(codes: range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(codes)] = True
    return out


#: Bytes that are white space themselves, and lead bytes of characters that may be.
SPACES = _white(range(9, 14)) | _white(range(28, 33))
LEADS2, LEADS3 = _white(range(0xC2, 0xC3)), _white(range(0xE1, 0xE4))


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks start in the UTF-8 texts that begin at ``begins``: at each text and at each
    single space between characters that surely are no white space."""
    at = np.flatnonzero(data == 32)
    ahead = data[np.minimum(at + 1, len(data) - 1)]
    odd = SPACES[ahead] | LEADS2[ahead] | LEADS3[ahead] | (at + 1 == len(data))
    for back, leads in ((1, SPACES), (2, LEADS2), (3, LEADS3)):
        odd |= (at >= back) & leads[data[np.maximum(at - back, 0)]]
    start = np.zeros(len(data), dtype=bool)
    start[at[~odd]] = True
    start[begins[begins < len(data)]] = True
    return np.flatnonzero(start)


class ChunkTable:
    """Open-addressing table from 128-bit chunk hashes to entry numbers."""

    def __init__(self, slots: int):
        self.shift = np.uint64(64 - slots.bit_length() + 1)
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.entry = np.full(self.slots, -1, dtype=np.int32)
        self.first = np.zeros(1 << 12, dtype=np.uint64)
        self.second = np.zeros(1 << 12, dtype=np.uint64)
        self.size = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Entry number of each hash, or -1."""
        slot = self._slot(first)
        out = np.full(len(first), -1, dtype=np.int64)
        todo = np.arange(len(first))
        while len(todo):
            e = self.entry[slot]
            used = e >= 0
            hit = used & (self.first[e] == first[todo]) & (self.second[e] == second[todo])
            out[todo[hit]] = e[hit]
            more = used & ~hit
            todo, slot = todo[more], (slot[more] + 1) & (self.slots - 1)
        return out

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Enter distinct new hashes, numbered on from ``size``."""
        while len(self.first) < self.size + len(first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.second = np.concatenate([self.second, np.zeros_like(self.second)])
        numbers = np.arange(self.size, self.size + len(first), dtype=np.int32)
        self.first[numbers], self.second[numbers] = first, second
        self.size += len(first)
        slot = self._slot(first)
        while len(numbers):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = numbers[free]  # of several, the last stays
            left = self.entry[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & (self.slots - 1)


class ChunkHasher:
    """Two polynomial hashes of many byte ranges at once, from prefix sums modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 1 << 62)) * 4 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        out[1:] = base % (1 << 64)
        return np.multiply.accumulate(out)

    def hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            self.powers = self._powers(self.base, len(data) + 1)
            self.inverses = self._powers(self.inverse, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        own = (sums[ends] - sums[starts]) * self.inverses[starts]
        return (own ^ (own >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)


def _append(store: np.ndarray, bounds: np.ndarray, base: int, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``store`` and ``bounds`` with entries of these sizes from number ``base`` on; both double as needed."""
    at = bounds[base]
    while len(bounds) <= base + len(sizes):
        bounds = np.concatenate([bounds, np.zeros_like(bounds)])
    while len(store) < at + len(values):
        store = np.concatenate([store, np.zeros_like(store)])
    store[at : at + len(values)] = values
    bounds[base + 1 : base + 1 + len(sizes)] = at + np.cumsum(sizes)
    return store, bounds


class ChunkEncoder:
    """Encodes texts with a byte-level tokenizer, each distinct chunk once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a byte-level vocabulary writes each byte as one character
        self.table = ChunkTable(SLOTS)
        self.hashers = ChunkHasher(1), ChunkHasher(2)
        self.flat = np.zeros(1 << 16, dtype=np.uint16)
        self.bounds = np.zeros(1 << 16, dtype=np.int64)
        self.text = np.zeros(1 << 18, dtype=np.uint8)
        self.text_bounds = np.zeros(1 << 16, dtype=np.int64)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint16) for e in found]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the ids and the bytes of new chunks, in the order given.

        Chunks that begin with a space, end with none and hold no other go to the tokenizer
        together: where each one's ids end follows from the tokens' byte lengths."""
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        last = data[np.maximum(ends - 1, 0)]
        plain = (data[starts] == 32) & (spaces[ends] - spaces[starts] == 1) & ~SPACES[last]
        for back, leads in ((2, LEADS2), (3, LEADS3)):
            plain &= ~leads[data[np.maximum(ends - back, 0)]]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        alone = len(order) - int(plain.sum())
        lengths = ends[order] - starts[order]
        text = gather(data, starts[order], lengths).tobytes()
        stops = np.cumsum(lengths)
        edges = [*range(0, len(order) - alone, TOGETHER), *range(len(order) - alone, len(order) + 1)]
        places = np.concatenate([[0], stops])[edges]
        ids = np.concatenate(self._ids([text[a:b] for a, b in zip(places, places[1:])]))
        begin = np.searchsorted(np.cumsum(self.sizes[ids]), stops, side="left") + 1
        sizes = np.empty(len(order), dtype=np.int64)
        sizes[order] = np.diff(begin, prepend=0)
        first = np.empty(len(order), dtype=np.int64)
        first[order] = begin
        flat = gather(ids, first - sizes, sizes)
        base = self.table.size
        self.flat, self.bounds = _append(self.flat, self.bounds, base, flat, sizes)
        own = ends - starts
        self.text, self.text_bounds = _append(self.text, self.text_bounds, base, gather(data, starts, own), own)

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Chunks that are not the ones their entries were made from."""
        begin, sizes = self.text_bounds[entry], ends - starts
        differ = self.text_bounds[entry + 1] - begin != sizes
        held = gather(self.text, np.where(differ, 0, begin), np.where(differ, 0, sizes))
        own = data if not differ.any() else gather(data, np.where(differ, 0, starts), np.where(differ, 0, sizes))
        if not np.array_equal(held, own):
            at = np.cumsum(np.where(differ, 0, sizes))
            differ[np.searchsorted(at, np.flatnonzero(held != own), side="right")] = True
        return np.flatnonzero(differ)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each UTF-8 text as 16-bit integers."""
        if any(len(t) > WINDOW for t in texts):
            return [self._parts(t) if len(t) > WINDOW else self._encode([t])[0] for t in texts]
        return self._encode(texts)

    def _parts(self, text: bytes) -> np.ndarray:
        """Ids of a long text, a window at a time."""
        out, at, size = [], 0, WINDOW
        while at < len(text):
            window = np.frombuffer(text, dtype=np.uint8, count=min(size, len(text) - at), offset=at)
            if at + len(window) < len(text):
                inner = cuts(window[:-3], np.zeros(1, dtype=np.int64))[1:]
                if not len(inner):
                    size *= 2
                    continue
                window = window[: inner[-1]]
            out += self._encode([window.tobytes()])
            at, size = at + len(window), WINDOW
        return np.concatenate(out)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.table.size > SLOTS // 2 or self.text_bounds[self.table.size] > HELD:
            self.table.clear()
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data):
            return [np.zeros(0, dtype=np.uint16) for _ in texts]
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        starts = cuts(data, begins)
        ends = np.append(starts[1:], len(data))
        first, second = (h.hash(data, starts, ends) for h in self.hashers)
        entry = self.table.find(first, second)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, one, back = np.unique(first[missing], return_index=True, return_inverse=True)
            new = missing[one]
            self._learn(data, starts[new], ends[new])
            entry[missing] = self.table.size + back
            self.table.add(first[new], second[new])
        wrong = self._unlike(data, starts, ends, entry)
        if len(wrong):  # their hashes are those of other chunks, so they get numbers that no hash leads to
            self._learn(data, starts[wrong], ends[wrong])
            entry[wrong] = self.table.size + np.arange(len(wrong))
            self.table.size += len(wrong)
        sizes = self.bounds[entry + 1] - self.bounds[entry]
        ids = gather(self.flat, self.bounds[entry], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        stops = upto[np.searchsorted(starts, begins + lengths)]
        return np.split(ids, stops[:-1])


@lru_cache(maxsize=2)
def _loaded(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, part, start, n, ids): ids with the separator; start counts within the partition."""

    def run(batches):
        encoder, part, start = _loaded(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(batch, "text", 1 << 20):
                ids = [np.append(x, np.uint16(SEPARATOR)) for x in encoder.encode([t.encode() for t in texts_of(batch, "text", a, b)])]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.full(len(n), part, dtype=np.int32)),
                        pa.array(start + np.cumsum(n) - n),
                        pa.array(n),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "part", "start", "n", "ids"],
                )
                start += int(n.sum())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, part int, start long, n long, ids binary"
    )


def offsets(tokens: DataFrame) -> DataFrame:
    """(part, base, total): where each partition's ids begin; one row per partition."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("tokens"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        "part", (F.sum("tokens").over(upto) - F.col("tokens")).alias("base"), F.sum("tokens").over(whole).alias("total")
    )


def cut(tokens: DataFrame, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: the part of a document that lies in one sequence."""
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, padded_length int" + (", ids binary" if with_ids else "")
    )

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, at, n, total, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype="<u2").astype("<u4").tobytes()
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    take = min(n - done, length - offset)
                    own = ids[4 * done : 4 * (done + take)]
                    held = min(length, total - sequence * length)
                    padded = held if held & (held - 1) == 0 else length
                    row = (doc_id, done, take, zlib.crc32(own), n, sequence, offset, padded)
                    rows.append((*row, own) if with_ids else row)
                    done += take
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names[: len(rows[0])]
                )

    placed = tokens.join(F.broadcast(offsets(tokens)), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "total", "ids"
    )
    return placed.mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; ``with_ids`` adds each piece's ids (little-endian 32-bit)."""
    return cut(materialize(spark, tokenise(docs, path), "packing-ids"), length, with_ids)
