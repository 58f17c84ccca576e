"""Media columns: progressive JPEG written and read with numpy.

The reader takes any progressive JPEG with 8-bit samples: it accumulates spectral-selection and
successive-approximation scans into one coefficient array for each component, transforms them back,
upsamples the chroma and returns full-resolution RGB.

The writer stores bytes without loss in the format's own unit, the quantised DCT coefficient (all
quantisers are 1): byte b becomes the coefficient b + 256, one block for every 64 bytes.  All
coefficients then have nine bits and none is zero, so the scans need few codes: one DC scan and its
refinement send the DC coefficients; two spectral bands send each AC coefficient's top five
bits and four refinements the rest, each refinement as runs of blocks without new coefficients.
Luma takes two thirds of the blocks and either chroma component (subsampled 2 x 2) a sixth.  A
comment segment holds the payload's length.

Samples that leave 0 to 255 are clipped, as the format has it; the payload is read from coefficients and
loses nothing by it.

Edge cases: null and empty texts make one block of zeros; repeated texts give equal bytes; very long
texts make one image whose width grows once it is MOST_ROWS high; there are no ties to break; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import slices, texts_of

UNIT = 64
OFFSET = 256
MOST_ROWS = 4095  # of 16 lines: a side has at most 65535 samples
BANDS = ((1, 5), (6, 63))
DC_TOP = 1  # bits of a DC coefficient that are left to a refinement
TOP = 4  # bits of an AC coefficient that are left to refinements
RUN_MOST = (1 << 15) - 1
MARKER = re.compile(b"\xff[^\x00]", re.DOTALL)


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag index."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


def _cosines() -> np.ndarray:
    """Orthonormal inverse DCT: samples = C @ coefficients @ C.T."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)).astype(np.float32)


ZIGZAG, COSINES = _zigzag(), _cosines()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def _codes(kind: int, place: int, symbols: tuple[int, ...]) -> bytes:
    """A Huffman table whose n-th symbol has a code of n bits (n - 1 ones and a zero)."""
    counts = bytes(1 if n < len(symbols) else 0 for n in range(16))
    return _segment(0xC4, bytes([kind << 4 | place]) + counts + bytes(symbols))


@lru_cache(maxsize=256)
def _scan_head(components: tuple[int, ...], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al]))


def _scan(components: tuple[int, ...], ss: int, se: int, ah: int, al: int, bits: np.ndarray) -> bytes:
    """Scan header and entropy-coded bits, filled up with ones and stuffed."""
    packed = np.packbits(bits)
    packed[-1:] |= np.uint8((1 << -len(bits) % 8) - 1)
    return _scan_head(tuple(components), ss, se, ah, al) + packed.tobytes().replace(b"\xff", b"\xff\x00")


#: Bit lengths that a difference of DC coefficients may have.
DC_SIZES = tuple(range(10))


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits of each difference from -511, filled up to a row, and which of them count."""
    most = DC_SIZES[-1]
    bits = np.zeros((2 ** (most + 1) - 1, 4 + most), dtype=np.uint8)
    counts = np.zeros(bits.shape, dtype=bool)
    for row, step in enumerate(range(1 - 2**most, 2**most)):
        size = abs(step).bit_length()
        word = _number(size, 4) + _number(step + (1 << size) - 1 if step < 0 else step, size)
        bits[row, : len(word)], counts[row, : len(word)] = word, True
    return bits, counts


def _differences(units: np.ndarray) -> np.ndarray:
    """Bits of a first DC scan from (units, 6) values: four luma blocks and two of chroma."""
    luma = np.diff(units[:, :4].ravel(), prepend=0).reshape(-1, 4)
    chroma = np.diff(units[:, 4:], axis=0, prepend=0)
    steps = np.concatenate([luma, chroma], axis=1).ravel()
    bits, counts = (table[steps + (len(table) >> 1)] for table in DIFFERENCES)
    return bits[counts]


def _number(value: int, bits: int) -> list[int]:
    return [value >> k & 1 for k in range(bits - 1, -1, -1)]


DIFFERENCES = _difference_codes()


def _refinement(correction: np.ndarray) -> tuple[tuple[int, ...], np.ndarray]:
    """Symbols used and bits of a refinement without new coefficients, from (blocks, band) bits."""
    runs = []
    for at in range(0, len(correction), RUN_MOST):
        n = min(RUN_MOST, len(correction) - at)
        runs.append((n.bit_length() - 1, n, at))
    symbols = tuple(dict.fromkeys(r << 4 for r, _, _ in runs))
    bits = []
    for r, n, at in runs:
        k = symbols.index(r << 4)
        bits += [np.array([1] * k + [0] + _number(n - (1 << r), r), dtype=np.uint8), correction[at : at + n].ravel()]
    return symbols, np.concatenate(bits)


@lru_cache(maxsize=256)
def _mcu_order(columns: int, rows: int) -> np.ndarray:
    """Blocks (luma, Cb, Cr one after another) in the order of interleaved scans."""
    luma = np.arange(4 * rows * columns).reshape(rows, 2, columns, 2).transpose(0, 2, 1, 3).reshape(rows * columns, 4)
    unit = np.arange(rows * columns)[:, None]
    return np.concatenate([luma, 4 * rows * columns + unit, 5 * rows * columns + unit], axis=1).ravel()


def write(payload: bytes) -> bytes:
    """A progressive JPEG that holds ``payload``, whose length is a positive multiple of UNIT."""
    units = -(-len(payload) // (6 * UNIT))
    columns = -(-units // MOST_ROWS)
    rows = -(-units // columns)
    units = rows * columns
    data = np.zeros(units * 6 * UNIT, dtype=np.uint16)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    blocks = (data + OFFSET).reshape(-1, UNIT)
    parts = {1: slice(4 * units), 2: slice(4 * units, 5 * units), 3: slice(5 * units, 6 * units)}
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, bytes([0, 0, 0, 0, len(DC_SIZES), *[0] * 12, *DC_SIZES])),  # four bits each
    ]
    order = _mcu_order(columns, rows)
    dc = blocks[order, 0].astype(np.int64)
    out.append(_scan((1, 2, 3), 0, 0, 0, DC_TOP, _differences((dc >> DC_TOP).reshape(-1, 6))))
    out += [_scan((1, 2, 3), 0, 0, al + 1, al, (dc >> al & 1).astype(np.uint8)) for al in range(DC_TOP - 1, -1, -1)]
    out.append(_codes(1, 0, (9 - TOP,)))
    top = (blocks >> TOP << 2).astype(np.uint8)  # code 0, then five bits
    top = np.unpackbits(top[:, :, None], axis=2, count=6)
    for ss, se in BANDS:
        out += [_scan((c,), ss, se, 0, TOP, top[own, ss : se + 1].ravel()) for c, own in parts.items()]
    table, low = None, blocks[:, 1:].astype(np.uint8)
    for al in range(TOP - 1, -1, -1):
        correction = low >> al & 1
        for c, own in parts.items():
            symbols, bits = _refinement(correction[own])
            if symbols != table:
                out.append(_codes(1, 0, symbols))
                table = symbols
            out.append(_scan((c,), 1, 63, al + 1, al, bits))
    return b"".join([*out, b"\xff\xd9"])


@lru_cache(maxsize=256)
def _block_orders(down: int, across: int, height: int, width: int, v: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in the order of a scan of one component, and of interleaved scans (units, blocks of one)."""
    own = (np.arange(down)[:, None] * width + np.arange(across)).ravel()
    grid = np.arange(height * width).reshape(height // v, v, width // h, h).transpose(0, 2, 1, 3)
    return own, grid.reshape(-1, v * h)


def _taken(blocks: np.ndarray) -> slice | np.ndarray:
    """An index of these blocks: a slice, which copies nothing, where they follow each other."""
    return slice(int(blocks[0]), int(blocks[-1]) + 1) if blocks[-1] - blocks[0] == len(blocks) - 1 else blocks


@dataclass
class Component:
    """Sampling factors, quantisers and accumulated coefficients (zigzag order) of a component."""

    h: int
    v: int
    table: int
    across: int  # blocks that hold samples
    down: int
    width: int  # blocks with those that fill up the last units
    height: int
    coefficients: np.ndarray = None
    own_blocks: np.ndarray = None  # in the order of a scan of this component alone
    unit_blocks: np.ndarray = None  # (units, blocks of one) in interleaved order

    def __post_init__(self):
        self.coefficients = np.zeros((self.height * self.width, 64), dtype=np.int32)
        self.own_blocks, self.unit_blocks = _block_orders(self.down, self.across, self.height, self.width, self.v, self.h)


class Codes(dict):
    """Symbols by code; the lengths that codes have."""

    lengths: list[int] = []


class Bits:
    """A scan segment's bits, read one code at a time or many at once."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8))
        self.text = None
        self.at = 0

    def take(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        if len(out) < n:
            raise ValueError("the scan ends early")
        return out

    def digits(self) -> bytes:
        if self.text is None:
            self.text = (self.bits + 48).tobytes()
        return self.text

    def number(self, n: int) -> int:
        self.digits()
        if self.at + n > len(self.text):
            raise ValueError("the scan ends early")
        out = int(self.text[self.at : self.at + n], 2) if n else 0
        self.at += n
        return out

    def symbol(self, codes: Codes) -> int:
        text, at = self.digits(), self.at
        for n in codes.lengths:
            if (found := codes.get(text[at : at + n])) is not None:
                self.at = at + n
                return found
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        value = self.number(n)
        return value if n == 0 or value >> n - 1 else value - (1 << n) + 1


@dataclass
class Image:
    """What a JPEG's segments say, and its components' coefficients."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    components: dict[int, Component] = field(default_factory=dict)

    def planes(self) -> list[np.ndarray]:
        """Samples of each component at full resolution, as float32 around 128."""
        out = []
        most_h, most_v = (max(getattr(c, k) for c in self.components.values()) for k in "hv")
        for c in self.components.values():
            blocks = np.zeros((len(c.coefficients), 64), dtype=np.float32)
            blocks[:, ZIGZAG] = c.coefficients * self.quantisers[c.table]
            half = blocks.reshape(-1, 8) @ COSINES.T  # rows
            full = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES.T  # columns
            samples = full.reshape(c.height, c.width, 8, 8).transpose(0, 3, 1, 2).reshape(8 * c.height, 8 * c.width)
            samples = np.repeat(np.repeat(samples, most_v // c.v, axis=0), most_h // c.h, axis=1)
            out.append(samples[: self.height, : self.width] + 128)
        return out

    def rgb(self) -> np.ndarray:
        """(height, width, 3) tensor of 8-bit samples."""
        planes = self.planes()
        if len(planes) == 1:
            channels = [planes[0]] * 3
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            channels = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
        out = np.empty((*planes[0].shape, 3), dtype=np.uint8)
        for k, channel in enumerate(channels):
            out[:, :, k] = np.clip(np.rint(channel), 0, 255)
        return out


@lru_cache(maxsize=256)
def _code_table(counts: bytes, symbols: bytes) -> Codes:
    """Canonical codes, written as text of 0 and 1."""
    out, code, k = Codes(), 0, 0
    out.lengths = [n for n in range(1, 17) if counts[n - 1]]
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[format(code, f"0{n}b").encode()] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _read_dc(bits: Bits, image: Image, members: list[tuple[Component, dict]], ah: int, al: int) -> None:
    """One DC scan (or the part between two restarts), one component or several interleaved."""
    if len(members) == 1:
        orders = [members[0][0].own_blocks[:, None]]
    else:
        orders = [c.unit_blocks for c, _ in members]
    if ah:
        step = sum(o.shape[1] for o in orders)
        sent = bits.take(step * len(orders[0])).reshape(-1, step).astype(np.int32) << al
        at = 0
        for (c, _), order in zip(members, orders):
            c.coefficients[order, 0] |= sent[:, at : at + order.shape[1]]
            at += order.shape[1]
        return
    values = [[] for _ in members]
    turns = [(codes.get, codes.lengths, own.append) for (_, codes), order, own in zip(members, orders, values) for _ in range(order.shape[1])]
    text, at = bits.digits(), bits.at  # symbol() and signed() in place: there is one of each for a block
    for _ in range(len(orders[0])):
        for get, lengths, append in turns:
            for n in lengths:
                if (size := get(text[at : at + n])) is not None:
                    break
            else:
                raise ValueError("no such code")
            at += n
            if size:
                value = int(text[at : at + size], 2)
                append(value if text[at] == 49 else value - (1 << size) + 1)
                at += size
            else:
                append(0)
    if at > len(text):
        raise ValueError("the scan ends early")
    bits.at = at
    for (c, _), order, own in zip(members, orders, values):
        c.coefficients[order.ravel(), 0] = np.cumsum(own, dtype=np.int32) << al


@lru_cache(maxsize=256)
def _weights(code: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """What a code's bits and those behind it add up by, and the signed value of each sum."""
    sums = np.arange(1 << size, dtype=np.int32)
    weights = np.array([0] * code + [1 << k for k in range(size - 1, -1, -1)], dtype=np.uint8 if size <= 8 else np.uint16)
    return weights, np.where(sums >> size - 1, sums, sums - np.int32((1 << size) - 1)).astype(np.int32)


def _read_ac(bits: Bits, c: Component, codes: Codes, ss: int, se: int, al: int) -> None:
    """First scan of a spectral band."""
    blocks, width = c.own_blocks, se - ss + 1
    if len(codes) == 1 and 0 < (size := next(iter(codes.values()))) < 16:
        # a table of one symbol without a run: every coefficient has a code and ``size`` bits
        code = len(next(iter(codes)))
        sent = bits.take(len(blocks) * width * (code + size)).reshape(-1, code + size)
        weights, signed = _weights(code, size)
        c.coefficients[_taken(blocks), ss : se + 1] = (signed[sent @ weights] << al).reshape(-1, width)
        return
    run = 0
    for b in blocks:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, size = divmod(bits.symbol(codes), 16)
            if size:
                k += r
                c.coefficients[b, k] = bits.signed(size) << al
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.number(r) - 1
                break


def _correct(bits: Bits, part: np.ndarray, al: int) -> None:
    """One correction bit for each coefficient of ``part`` that is not zero."""
    if part.min(initial=1) > 0:
        part += (bits.take(part.size) << np.int32(al)).reshape(part.shape)
        return
    if np.count_nonzero(part) == part.size:
        sent = bits.take(part.size).reshape(part.shape).astype(np.int32) << al
        part += np.where(part > 0, sent, -sent)
        return
    flat = part.ravel()
    there = np.flatnonzero(flat)
    sent = bits.take(len(there)).astype(np.int32) << al
    flat[there] += np.where(flat[there] > 0, sent, -sent)
    part[...] = flat.reshape(part.shape)


def _correct_blocks(bits: Bits, c: Component, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
    own = _taken(blocks)
    part = c.coefficients[own, ss : se + 1]
    _correct(bits, part, al)
    if not isinstance(own, slice):  # else ``part`` is no copy
        c.coefficients[own, ss : se + 1] = part


def _refine_ac(bits: Bits, c: Component, codes: Codes, ss: int, se: int, al: int) -> None:
    """Refinement of a spectral band."""
    blocks = c.own_blocks
    at = 0
    while at < len(blocks):
        row, k = c.coefficients[blocks[at]], ss
        while k <= se:
            r, size = divmod(bits.symbol(codes), 16)
            if size == 0 and r < 15:
                run = (1 << r) + bits.number(r)
                rest = row[k : se + 1].copy()
                if run > 1 and k == ss:  # a run of whole blocks
                    _correct_blocks(bits, c, blocks[at : at + run], ss, se, al)
                    at += run - 1
                else:
                    _correct(bits, rest, al)
                    row[k : se + 1] = rest
                    if run > 1:
                        _correct_blocks(bits, c, blocks[at + 1 : at + run], ss, se, al)
                        at += run - 1
                break
            new = (1 if bits.number(1) else -1) << al if size else 0
            while k <= se:
                if row[k]:
                    if bits.number(1):
                        row[k] += (1 << al) if row[k] > 0 else -(1 << al)
                elif r == 0:
                    if new:
                        row[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        at += 1


def read(media: bytes) -> Image:
    """Accumulate all scans of a progressive JPEG."""
    image, tables, at = Image(), {}, 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = media[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide, place = divmod(body[0], 16)
                n = 64 * (wide + 1)
                image.quantisers[place] = np.frombuffer(body[1 : n + 1], dtype=">u2" if wide else np.uint8).astype(np.float32)
                body = body[n + 1 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            listed = [(body[6 + 3 * i], *divmod(body[7 + 3 * i], 16), body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(x[1] for x in listed), max(x[2] for x in listed)
            units_x, units_y = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for name, h, v, table in listed:
                across = -(-(-(-image.width * h // most_h)) // 8)
                down = -(-(-(-image.height * v // most_v)) // 8)
                image.components[name] = Component(h, v, table, across, down, units_x * h, units_y * v)
        elif marker == 0xDD:
            if struct.unpack(">H", body)[0]:
                raise ValueError("restart intervals are not supported")
        elif marker == 0xDA:
            n = body[0]
            members = [(image.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            ss, se, approximation = body[1 + 2 * n : 4 + 2 * n]
            ah, al = divmod(approximation, 16)
            if (found := MARKER.search(media, at)) is None:
                raise ValueError("the scan ends early")
            end = found.start()
            bits = Bits(media[at:end])
            at = end
            if ss == 0:
                _read_dc(bits, image, [(c, tables.get(t >> 4, Codes())) for c, t in members], ah, al)
            elif ah:
                _refine_ac(bits, members[0][0], tables[16 | members[0][1] & 15], ss, se, al)
            else:
                _read_ac(bits, members[0][0], tables[16 | members[0][1] & 15], ss, se, al)
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")


def payload_of(image: Image) -> bytes:
    """The bytes that :func:`write` stored."""
    length = int(image.comment.removeprefix(b"payload "))
    blocks = np.concatenate([c.coefficients for c in image.components.values()])
    return (blocks.ravel()[:length] - OFFSET).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean and spread of each channel, and a 16-bin histogram of the luma-like mean."""
    # one count over three ranges of 256 levels, one for each channel
    counts = np.bincount((rgb.reshape(-1, 3) + np.array([0, 256, 512])).ravel(), minlength=768).reshape(3, 256)
    levels, n = np.arange(256), rgb.shape[0] * rgb.shape[1]
    mean = counts @ levels / n
    spread = np.sqrt(np.maximum(counts @ levels**2 / n - mean**2, 0))
    bins = counts.sum(axis=0).reshape(16, 16).sum(axis=1) / (3 * n)
    return f"{rgb.shape[1]}x{rgb.shape[0]} " + " ".join(f"{x:.4f}" for x in (*mean, *spread, *bins))


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded, as a progressive JPEG."""

    def run(batches):
        for batch in batches:
            for start, stop in slices(batch, "text", 2 << 20):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch, "text", start, stop)]
                padded = [r + bytes(UNIT if not r else -len(r) % UNIT) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([write(p) for p in padded], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def decode(media: DataFrame) -> DataFrame:
    """(doc_id, width, height, rgb): full-resolution tensors of any progressive JPEG column."""

    def run(batches):
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rgb = None if raw is None else read(raw).rgb()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc_id], pa.int64()),
                        pa.array([None if rgb is None else rgb.shape[1]], pa.int32()),
                        pa.array([None if rgb is None else rgb.shape[0]], pa.int32()),
                        pa.array([None if rgb is None else rgb.tobytes()], pa.binary()),
                    ],
                    names=["doc_id", "width", "height", "rgb"],
                )

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(
        run, "doc_id long, width int, height int, rgb binary"
    )


def op4(docs: DataFrame) -> DataFrame:
    """The contract's digest, all of it from the stored bytes read back, and the RGB tensor (height x width x 3)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns)):
                image = read(media)
                payload, rgb = payload_of(image), image.rgb()
                rows.append((
                    doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature(rgb),
                    rgb.shape[1], rgb.shape[0], rgb.tobytes(),
                ))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.binary()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    return encode(docs).mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, width int, height int, rgb binary",
    )


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "rgb"]
