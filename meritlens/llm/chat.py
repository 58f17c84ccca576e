"""Chat formatting by columnar byte assembly.

Every turn is rendered on its own, so a conversation of any length is spread over batches: a
batch's segments (headers, escaped contents, footers) are laid out by cumulative offsets and
scattered into one preallocated buffer that becomes an Arrow column.  The loss mask of a turn is a
byte range of its segment.  A conversation's text is its segments in turn order.

Format: ``<s>ROLE\\n`` then the text then ``</s>\\n``; a user's text stands between ``[INST] `` and
`` [/INST]``.  Control strings inside roles and texts get a backslash after their first character,
and one more where there are some already, so reading takes one off again; line feeds in roles are
written as control strings of their own.

Edge cases: null role and text count as empty; turns with equal numbers are ordered by role, then
text; repeated rows are turns of their own; rows without a turn come first; rows without a conv_id are one
conversation; a very long text is one segment, and a conversation of any length is read as a stream, by
one task, as its hash must be; an empty table gives only the added conversation; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, END, USER_BEGIN, USER_END, LINE = "<s>", "</s>", "[INST]", "[/INST]", "<n>"
CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|n>|INST\]|/INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|n>|INST\]|/INST\])")
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", LINE)


def unescape_role(role: str) -> str:
    return unescape(role.replace(LINE, "\n"))


def frame(role: str) -> tuple[bytes, bytes]:
    """Header and footer of a role's turns."""
    inner = (f"{USER_BEGIN} ", f" {USER_END}") if role == "user" else ("", "")
    return f"{BEGIN}{escape_role(role)}\n{inner[0]}".encode(), f"{inner[1]}{END}\n".encode()


def _joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the n + 1 offsets."""
    ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), np.concatenate([[0], ends])


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """out[at[i] : at[i] + sizes[i]] = data[starts[i] : starts[i] + sizes[i]] for all i at once."""
    before = np.cumsum(sizes) - sizes
    k = np.arange(int(sizes.sum()))
    out[k + np.repeat(at - before, sizes)] = data[k + np.repeat(starts - before, sizes)]


def assemble(roles: list[str], texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Segments of turns as one Arrow column, and the byte range of each one's text."""
    kinds = {r: i for i, r in enumerate(dict.fromkeys(roles))}
    kind = np.array([kinds[r] for r in roles], dtype=np.int64)
    frames = [frame(r) for r in kinds]
    heads, head_at = _joined([h for h, _ in frames])
    feet, foot_at = _joined([f for _, f in frames])
    body, body_at = _joined([escape(t).encode("utf-8", "surrogatepass") for t in texts])
    head_size, foot_size, body_size = np.diff(head_at)[kind], np.diff(foot_at)[kind], np.diff(body_at)
    ends = np.cumsum(head_size + body_size + foot_size)
    starts = ends - (head_size + body_size + foot_size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    _scatter(out, starts, heads, head_at[:-1][kind], head_size)
    _scatter(out, starts + head_size, body, body_at[:-1], body_size)
    _scatter(out, starts + head_size + body_size, feet, foot_at[:-1][kind], foot_size)
    offsets = np.concatenate([[0], ends])
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(roles), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]
    )
    return column, head_size, head_size + body_size


def _format_batches(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        roles = [r or "" for r in batch.column(2).to_pylist()]
        texts = [t or "" for t in batch.column(3).to_pylist()]
        segments, begin, end = assemble(roles, texts)
        loss = np.array([r == LOSS_ROLE for r in roles])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                segments.cast(pa.binary()),
                pa.array(np.where(loss, begin, 0).astype(np.int32)),
                pa.array(np.where(loss, end, 0).astype(np.int32)),
            ],
            names=["conv_id", "turn", "segment", "loss_start", "loss_end"],
        )


def in_order(conversations: DataFrame) -> DataFrame:
    """Each conversation's rows one after another, by turn."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end) in conversation order.

    The loss range is in bytes of the segment and empty for turns that are not learned."""
    return in_order(conversations).mapInArrow(
        _format_batches, "conv_id long, turn long, segment binary, loss_start int, loss_end int"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations, for those that fit one value."""
    turns = format_turns(conversations).withColumn("place", F.monotonically_increasing_id())
    return turns.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", F.decode("segment", "UTF-8").alias("s")))), lambda x: x["s"]), ""
        ).alias("formatted")
    )


class Digest:
    """What is read back from one conversation's segments."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.counts = Counter()

    def add(self, text: str, masked: list[str]) -> None:
        """More of the conversation's text, cut into turns by its control strings alone, and what is learned of it."""
        for role, body in TURN.findall(text):
            role = unescape_role(role)
            if role == "user":
                body = body.removeprefix(f"{USER_BEGIN} ").removesuffix(f" {USER_END}")
            self.turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.counts["turns"] += 1
        for learned in map(unescape, masked):
            self.loss.update(learned.encode("utf-8", "surrogatepass"))
            self.counts["loss"] += len(learned)
        self.counts["all"] += len(text)

    def row(self, conv_id):
        return (conv_id, self.counts["turns"], self.turns.hexdigest(), self.counts["loss"], self.loss.hexdigest(), self.counts["all"])


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _digest_batches(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)
    current, digest = None, None
    for batch in batches:
        rows = []
        for conv_id, run in groupby(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))), key=lambda r: r[0]):
            if digest is None or conv_id != current:
                if digest is not None:
                    rows.append(digest.row(current))
                current, digest = conv_id, Digest()
            parts = [r[1:] for r in run]
            text = b"".join(p for p, _, _ in parts).decode("utf-8", "surrogatepass")
            digest.add(text, [p[start:end].decode("utf-8", "surrogatepass") for p, start, end in parts])
        if rows:
            yield emit(rows)
    if digest is not None:
        yield emit([digest.row(current)])


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digest, read from the joined segments of :func:`format_turns`, a batch of a conversation at a time."""
    return formatted.mapInArrow(
        _digest_batches,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op2(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_turns(rows.unionByName(added)))
