"""A folder of files in mixed formats as one table: ``spark.read.format("records").load(path)``.

Each file is a partition; JSON lines are cut into byte ranges, each read by its own task.  The driver lists names and sizes
and reads no text.  Rows are (path, format, value, error): a record as JSON text, or why a file or line gave none.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meritlens.sources import records as rec
from meritlens.sources.readers import TABLE_FIELDS
from meritlens.sources.resume import parse_resume, split_pasted
from meritlens.sources.schema import from_json_lines

Parser = Callable[[str], Iterator[Mapping[str, Any]]]
SCHEMA = "path string, format string, value string, error string"
#: Bytes of JSON lines for one task.
SPLIT = 64 << 20
#: Records for one Arrow batch, and their text.
BATCH, BATCH_CHARS = 1024, 4 << 20
LINES = ("jsonl", "ndjson")


def text_of(data: bytes) -> str:
    """Bytes as text: UTF-8 without its mark, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _parsed(line: str) -> Any:
    try:
        return json.loads(line)
    except json.JSONDecodeError:
        return None


def objects(text: str) -> Iterator[Mapping[str, Any]]:
    """A JSON object, the objects of an array, or of lines of which some can be read; a network export becomes a record."""
    try:
        whole = json.loads(text)
    except json.JSONDecodeError:
        whole = [v for v in map(_parsed, text.splitlines()) if v is not None]
        if not whole:
            raise
    for one in whole if isinstance(whole, list) else [whole]:
        if isinstance(one, Mapping):
            yield rec.from_network_export(one) if "positions" in one else rec.normalized(dict(one))


def table(separator: str) -> Parser:
    """A table with a header, columns by :data:`TABLE_FIELDS`."""

    def parse(text: str) -> Iterator[Mapping[str, Any]]:
        for row in csv.DictReader(io.StringIO(text, newline=""), delimiter=separator):
            fields: dict[str, Any] = {}
            for name, value in row.items():
                field = TABLE_FIELDS.get((name or "").strip().lower())
                if field and field not in fields:
                    fields[field] = (value or "").strip()
            years = re.search(r"\d+(?:\.\d+)?", fields.get("years_of_experience", ""))
            skills = [s.strip() for s in re.split("[;,|]", fields.get("skills", "")) if s.strip()]
            yield rec.canonical(fields | {"years_of_experience": float(years[0]) if years else 0.0, "skills": list(map(rec.simple_skill, skills))}, "csv")

    return parse


def resumes(text: str) -> Iterator[Mapping[str, Any]]:
    """One or several resumes; a blank text has none."""
    yield from map(parse_resume, filter(None, split_pasted(text)))


#: Suffix to parser of a whole file.
PARSERS: dict[str, Parser] = {"json": objects, "csv": table(","), "tsv": table("\t"), "txt": resumes, "md": resumes}


@dataclass
class Piece(InputPartition):
    path: str
    kind: str
    start: int
    end: int


def pieces_of(files: Sequence[tuple[str, int]], kinds: Sequence[str], split: int) -> list[Piece]:
    """The partitions of files (path, bytes) of known kinds, in the order of their paths."""
    out: list[Piece] = []
    for path, size in sorted(files):
        low = path.lower()
        packed = low.endswith(".gz")
        kind = low.removesuffix(".gz").rsplit("/", 1)[-1].rpartition(".")[2]
        if kind not in kinds or not size:
            continue
        step = size if packed or kind not in LINES else split
        out += [Piece(path, kind, at, min(at + step, size)) for at in range(0, size, step)]
    return out


def lines_between(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end); the last may end behind it."""
    if start:
        stream.seek(start - 1)
        stream.readline()  # the rest of a line that another range has
    at = stream.tell()
    while at < end:
        line = stream.readline()
        if not line:
            return
        at += len(line)
        yield line


def opened(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_source(parsers: Mapping[str, Parser] | None = None) -> type[DataSource]:
    """The data source class, with more parsers by suffix; it travels to the tasks with them."""
    known = {**PARSERS, **(parsers or {})}

    class RecordReader(DataSourceReader):
        def __init__(self, options):
            self.path, self.split = options["path"], int(options.get("split", SPLIT))

        def partitions(self):
            from pyarrow import fs

            system, base = opened(self.path)
            info = system.get_file_info(base)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
            hidden = lambda p: any(part[:1] in "._" for part in p[len(base) :].split("/") if part)
            pieces = pieces_of([(i.path, i.size) for i in infos if i.is_file and not hidden(i.path)], [*known, *LINES], self.split)
            return pieces or [Piece("", "", 0, 0)]

        def read(self, piece):
            import pyarrow as pa

            held: list[tuple] = []
            chars = 0

            def batch():
                columns = list(zip(*held))
                return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "format", "value", "error"])

            for value, error in self._records(piece) if piece.path else ():
                held.append((piece.path, piece.kind, value, error))
                chars += len(value or "")
                if len(held) >= BATCH or chars >= BATCH_CHARS:
                    yield batch()
                    held, chars = [], 0
            if held:
                yield batch()

        def _records(self, piece):
            """(value, error) pairs; a file that cannot be parsed to its end gives an error after its records, and no failure."""
            with opened(self.path)[0].open_input_file(piece.path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if piece.path.lower().endswith(".gz") else raw
                if piece.kind in LINES:
                    end = piece.end if stream is raw else float("inf")
                    for line in lines_between(io.BufferedReader(stream) if stream is raw else stream, piece.start, end):
                        if text := text_of(line).strip():
                            yield text, None
                    return
                failed = None
                records = known[piece.kind](text_of(stream.read()))
                while failed is None:
                    try:
                        value = json.dumps(next(records), ensure_ascii=False)
                    except StopIteration:
                        return
                    except Exception as error:  # noqa: BLE001  the reason is a row of the result
                        failed = f"{type(error).__name__}: {error}"[:200]
                    else:
                        yield value, None
                yield None, failed

    class RecordSource(DataSource):
        @classmethod
        def name(cls):
            return "records"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return RecordReader(self.options)

    return RecordSource


def register(spark: SparkSession, parsers: Mapping[str, Parser] | None = None) -> None:
    """Make the format ``records`` known to a session."""
    spark.dataSource.register(record_source(parsers))


def read_folder(spark: SparkSession, path: str, split: int = SPLIT, parsers: Mapping[str, Parser] | None = None) -> DataFrame:
    """Candidate rows of all files below a path; what gave no record is left out (see ``error`` of the format)."""
    register(spark, parsers)
    return from_json_lines(spark.read.format("records").option("split", str(split)).load(path))
