"""Readers: files and values of several formats to candidate rows.

Each adapter gives a DataFrame of JSON lines, one record each; all of them meet in
:func:`meritlens.sources.schema.from_json_lines`.  A list of sources is a union.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.sources import records as rec
from meritlens.sources.resume import split_pasted
from meritlens.sources.resume_columns import parse_resumes
from meritlens.sources.schema import from_json_lines, generated_id

Adapter = Callable[[SparkSession, Any], DataFrame]
ADAPTERS: dict[str, Adapter] = {}
SUFFIXES: dict[str, str] = {}
#: Column names of tables and the fields they stand for; fixed values.
TABLE_FIELDS = {
    "name": "name", "full_name": "name", "candidate": "name", "title": "current_title", "current_title": "current_title",
    "headline": "headline", "company": "current_company", "current_company": "current_company", "summary": "summary",
    "about": "summary", "bio": "summary", "location": "location", "city": "location", "country": "country",
    "years": "years_of_experience", "experience": "years_of_experience", "years_of_experience": "years_of_experience",
    "skills": "skills", "industry": "current_industry",
}


def register_adapter(name: str, suffixes: Sequence[str] = ()):
    def keep(adapter: Adapter) -> Adapter:
        ADAPTERS[name] = adapter
        SUFFIXES.update(dict.fromkeys(suffixes, name))
        return adapter

    return keep


def list_adapters() -> list[str]:
    return sorted(ADAPTERS)


def detect_format(source: Any) -> str:
    """Dicts and lists of dicts are json; paths go by suffix; all else is text."""
    if isinstance(source, Mapping):
        return "network" if "positions" in source else "json"
    low = str(source).lower()
    low = low[:-3] if low.endswith(".gz") else low
    if "\n" not in low:
        for suffix, name in SUFFIXES.items():
            if low.endswith(suffix):
                return name
    return "json" if low.lstrip()[:1] in ("{", "[") else "text"


def lines_of(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "value string")


def decoded(content: str = "content") -> Column:
    """Bytes as text: UTF-8 without its mark, else Latin-1."""
    utf8 = F.expr(f"try_validate_utf8(cast({content} as string))")
    return F.regexp_replace(F.coalesce(utf8, F.decode(F.col(content), "ISO-8859-1")), "^\ufeff", "")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (also gzipped), strictly: a line that is no object or has no id fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.select(
        F.when(
            F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
            & F.get_json_object("value", "$.candidate_id").isNotNull(),
            F.col("value"),
        ).otherwise(F.raise_error(F.concat(F.lit("not a candidate record: "), F.substring("value", 1, 80)))).alias("value")
    )
    return from_json_lines(checked)


@register_adapter("json", [".json", ".jsonl", ".ndjson"])
def json_adapter(spark: SparkSession, source: Any) -> DataFrame:
    """A JSON array or object, or JSON lines; what is no object is skipped."""
    if isinstance(source, Mapping):
        return lines_of(spark, rec.as_lines([rec.normalized(dict(source))]))
    text = str(source)
    if "\n" in text or text.lstrip()[:1] in ("{", "["):
        whole = lines_of(spark, [text])
    else:
        whole = spark.read.text(text, wholetext=not text.lower().removesuffix(".gz").endswith(("jsonl", "ndjson")))
    parsed = F.try_parse_json("value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    # the parser ignores what follows a value, so a first line that is an object by itself tells lines from one object
    by_line = F.startswith(F.schema_of_variant(F.try_parse_json(F.try_element_at(lines, F.lit(1)))), F.lit("OBJECT"))
    items = F.coalesce(
        F.when(by_line, F.transform(lines, F.try_parse_json)),
        F.try_variant_get(parsed, "$", "array<variant>"),
        F.when(parsed.isNotNull(), F.array(parsed)),
        F.transform(lines, F.try_parse_json),
    )
    listed = whole.select(F.explode(items).alias("v")).where("v is not null")
    return listed.where(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("value"))


@register_adapter("csv", [".csv", ".tsv"])
def csv_adapter(spark: SparkSession, source: Any) -> DataFrame:
    """A table with a header; columns by :data:`TABLE_FIELDS`, others left out."""
    path = str(source)
    table = spark.read.csv(path, header=True, sep="\t" if path.lower().removesuffix(".gz").endswith(".tsv") else ",", multiLine=True, escape='"')
    named: dict[str, str] = {}
    for c in table.columns:
        if field := TABLE_FIELDS.get(c.lstrip("\ufeff").strip().lower()):
            named.setdefault(field, c)
    text = lambda field: F.trim(F.coalesce(F.col(f"`{named[field]}`"), F.lit(""))) if field in named else F.lit("")
    years = F.coalesce(F.regexp_extract(text("years_of_experience"), r"\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0))
    skills = F.filter(F.transform(F.split(text("skills"), "[;,|]"), F.trim), lambda s: s != "")
    seed = F.concat_ws("|", *(text(f) for f in ("name", "summary", "current_company", "current_title")), F.array_join(skills, " "), F.lit(""), F.lit(""))
    id_ = generated_id(seed)
    record = F.struct(
        id_.alias("candidate_id"),
        F.struct(
            F.when(text("name") == "", "Candidate").otherwise(text("name")).alias("anonymized_name"),
            F.when(text("headline") == "", text("current_title")).otherwise(text("headline")).alias("headline"),
            *(text(f).alias(f) for f in ("summary", "location", "country", "current_title", "current_company", "current_industry")),
            years.alias("years_of_experience"),
        ).alias("profile"),
        F.transform(skills, lambda s: F.struct(
            s.alias("name"), F.lit("intermediate").alias("proficiency"), F.lit(0).alias("endorsements"), F.lit(12).alias("duration_months"))).alias("skills"),
    )
    return table.select(F.to_json(record).alias("value"))


@register_adapter("text", [".txt", ".md"])
def text_adapter(spark: SparkSession, source: Any) -> DataFrame:
    """Resumes: a file each, or pasted text with one or several."""
    text = str(source)
    if "\n" not in text and text.lower().endswith((".txt", ".md")):
        files = spark.read.format("binaryFile").load(text)
        return parse_resumes(files.select(decoded().alias("value")))
    return parse_resumes(lines_of(spark, split_pasted(text)))


@register_adapter("network")
def network_adapter(spark: SparkSession, source: Mapping) -> DataFrame:
    return lines_of(spark, rec.as_lines([rec.from_network_export(source)]))


def _document_text(kind: str) -> Callable[[bytes], str]:
    """Text of a pdf or docx file, by libraries that may be absent."""
    import io

    if kind == "pdf":
        from pypdf import PdfReader

        return lambda data: "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    from docx import Document

    def text(data: bytes) -> str:
        doc = Document(io.BytesIO(data))
        cells = [c.text for t in doc.tables for r in t.rows for c in r.cells]
        margins = [p.text for s in doc.sections for part in (s.header, s.footer) for p in part.paragraphs]
        return "\n".join([*(p.text for p in doc.paragraphs), *cells, *margins])

    return text


def _document_adapter(kind: str) -> Adapter:
    def adapter(spark: SparkSession, source: Any) -> DataFrame:
        reader = _document_text(kind)  # fails here, on the driver, if the library is absent

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([reader(x) for x in batch.column(0).to_pylist()], pa.string())], names=["value"])

        return parse_resumes(spark.read.format("binaryFile").load(str(source)).select("content").mapInArrow(run, "value string"))

    return adapter


register_adapter("pdf", [".pdf"])(_document_adapter("pdf"))
register_adapter("docx", [".docx"])(_document_adapter("docx"))


def ingest_lines(spark: SparkSession, source: Any, format: str | None = None) -> DataFrame:
    """JSON lines of one source or of a list of sources of any formats."""
    if isinstance(source, (list, tuple)):
        if source and all(isinstance(x, Mapping) and "positions" not in x for x in source):
            return lines_of(spark, rec.as_lines(rec.hardened(list(source))))
        out = None
        for one in source:
            own = ingest_lines(spark, one, format)
            out = own if out is None else out.unionByName(own)
        return lines_of(spark, []) if out is None else out
    name = format or detect_format(source)
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name}; there are {', '.join(list_adapters())}")
    return ADAPTERS[name](spark, source)


def ingest(spark: SparkSession, source: Any, format: str | None = None) -> DataFrame:
    """Candidate rows of one source or of several."""
    return from_json_lines(ingest_lines(spark, source, format))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, grade, archetype) from a JSON map."""
    kind = "map<string,struct<grade:int,archetype:string>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("candidate_id", "l"))
    return rows.select("candidate_id", "l.grade", "l.archetype")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Evidence packets as variants."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("packet")).where("packet is not null")


def read_index(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """(candidate_id, vec) of a saved index; None if it is absent and not required."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if required or "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def pool_state(spark: SparkSession, path: str) -> str:
    """Digest of a pool's files by name, size and time: unchanged files need no new read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf).listStatus(target)
    return json.dumps(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))
