"""Writers: rankings, factor scores, risk reports, packets, indexes, workbooks.

Heads of rankings are small by definition and are written as one file; pools and indexes are written
as they are partitioned."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.functions import vectors as vx
from meritlens.operators.profiling import flag_counts

FACTOR_COLUMNS = (
    "candidate_id", "rank", "final_score", "technical_evidence", "career_fit", "seniority", "logistics", "behavioral", "trust",
    "confidence", "top10_eligible", "penalty", "role_relevance", "general_quality", "semantic_fit", "lexical_fit",
    "requirement_coverage", "engine",
)


def _one_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def as_file(spark: SparkSession, folder: str, path: str) -> None:
    """Make the only part of a folder written by one task the file ``path``, in any store that Spark knows."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (part,) = [f.getPath() for f in store.listStatus(source) if f.getPath().getName().startswith("part-")]
    store.delete(target, True)
    if not store.rename(part, target):
        raise OSError(f"could not move {part.toString()} to {path}")
    store.delete(source, True)


def joined(column: str) -> Column:
    return F.array_join(column, "|")


def write_ranking(ranked: DataFrame, path: str) -> None:
    """candidate_id, rank, score with six places, reasoning; by rank."""
    rows = ranked.select("candidate_id", "rank", F.format_string("%.6f", F.col("display_score")).alias("score"), "reasoning")
    _one_csv(rows.orderBy("rank"), path)


def write_factor_scores(ranked: DataFrame, path: str) -> None:
    lists = [c for c in ("risk_flags", "disqualifier_hits", "concern_notes") if c in ranked.columns]
    rows = ranked.select(*(c for c in FACTOR_COLUMNS if c in ranked.columns), *(joined(c).alias(c) for c in lists))
    _one_csv(rows.orderBy("rank"), path)


def risk_rows(ranked: DataFrame) -> DataFrame:
    """candidate_id, rank, score, penalty, flags, eligibility and a note for each ranked row."""
    flagged = F.size("risk_flags") > 0
    note = F.concat_ws("; ", *(
        F.when(c, t) for c, t in (
            (F.col("vetoed"), "vetoed: kept with score 0"), (flagged & ~F.col("vetoed"), "penalised for its flags"),
            (~F.col("top10_eligible"), "not eligible for the first ten"), (~flagged & F.col("top10_eligible"), "no concern found"))))
    return ranked.select(
        "candidate_id", "rank", F.col("final_score").alias("score"), "penalty", joined("risk_flags").alias("risk_flags"), "top10_eligible",
        note.alias("audit_note"),
    )


def write_risk_report(ranked: DataFrame, path: str) -> None:
    _one_csv(risk_rows(ranked).orderBy("rank"), path)


def risk_summary(ranked: DataFrame) -> DataFrame:
    """One row: rows, rows with a flag, rows not eligible, and flag counts by flag."""
    counts = flag_counts(ranked, "risk_flags").agg(F.sort_array(F.collect_list(F.struct("flag", "n"))).alias("flags"))
    totals = ranked.agg(
        F.count("*").alias("rows"), F.count_if(F.size("risk_flags") > 0).alias("any_flag"), F.count_if(~F.col("top10_eligible")).alias("top10_ineligible")
    )
    return totals.withColumn("k", F.lit(1)).join(counts.withColumn("k", F.lit(1)), "k").drop("k")


def write_risk_summary(ranked: DataFrame, path: str) -> None:
    summary = risk_summary(ranked).withColumn("flags", F.map_from_entries("flags"))
    summary.coalesce(1).select(F.to_json(F.struct("*"))).write.mode("overwrite").text(path)


def write_packets(packets: DataFrame, path: str) -> None:
    """One JSON object a line."""
    packets.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_index(vectors: DataFrame, path: str, id_col: str = "candidate_id", vec_col: str = "vec") -> None:
    """Unit vectors by id."""
    vectors.select(id_col, vx.unit(F.col(vec_col)).alias("vec")).write.mode("overwrite").parquet(path)


def write_workbook(rows: list[tuple], path: str) -> None:
    """A one-sheet workbook with inline strings (for collected heads)."""

    def letters(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    cells = []
    for r, row in enumerate(rows, 1):
        own = "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str("" if v is None else v))}</t></is></c>' for c, v in enumerate(row, 1))
        cells.append(f'<row r="{r}">{own}</row>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Ranking" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(cells)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, head + body)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The first rows as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def write_rescue_ledger(ledger: DataFrame, path: str, cutoff: int) -> None:
    """Rows that a keyword ranking has behind ``cutoff``, as CSV, and their number as JSON beside it."""
    _one_csv(ledger.orderBy("rank"), f"{path}/ledger")
    summary = ledger.agg(F.count("*").alias("rescued"), F.min("keyword_rank").alias("first_keyword_rank")).withColumn("cutoff", F.lit(cutoff))
    summary.coalesce(1).select(F.to_json(F.struct("*"))).write.mode("overwrite").text(f"{path}/summary")


def write_pool(lines: DataFrame, labels: DataFrame, job: str, path: str) -> None:
    """A labelled pool: JSON lines of records, a table of labels and the job's text."""
    lines.write.mode("overwrite").text(f"{path}/candidates")
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    labels.sparkSession.createDataFrame([(job,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/job")
