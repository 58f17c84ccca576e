"""Record repair in columns: JSON lines of any make to candidate rows, each with what was mended or why it was turned away.

No line is lost and none fails a job: every line gives one row, with ``error`` null or a typed reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions.text import strings
from meritlens.sources.schema import SIGNAL_KEYS, from_json_lines, generated_id

ERROR = "struct<kind:string,detail:string>"
CONTAINERS = {"profile": "OBJECT", "career_history": "ARRAY", "education": "ARRAY", "skills": "ARRAY"}
CANDIDATE_COLUMNS = ("candidate_id", "profile", "career_history", "education", "skills", "signals", "links")
SHOWN = 80


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY or the name of a plain type; null without a value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _judged(lines: DataFrame, column: str) -> DataFrame:
    """Lines with ``error``, ``_line`` (null where there is an error) and ``fixes`` of containers."""
    v = F.try_parse_json(F.col(column))
    blank = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"\s+", " ")) == ""
    say = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    reason = (
        F.when(blank, say("blank", F.lit(None))).when(v.isNull(), say("not_json", F.substring(column, 1, SHOWN)))
        .when(_kind(v) != "OBJECT", say("not_object", F.lower(_kind(v))))
    )
    ok = ~blank & v.isNotNull() & (_kind(v) == "OBJECT")
    other = [F.when(_kind(F.try_variant_get(v, f"$.{k}", "variant")).eqNullSafe(kind), None).otherwise(F.lit(k)) for k, kind in CONTAINERS.items()]
    signals = [_kind(F.try_variant_get(v, f"$.{k}", "variant")).eqNullSafe("OBJECT") for k in SIGNAL_KEYS]
    given = signals[0]
    for s in signals[1:]:
        given = given | s
    other.append(F.when(~given, "signals"))
    return lines.withColumns({
        "error": reason.cast(ERROR), "fixes": F.when(ok, F.array_compact(F.array(*other))), "_line": F.when(ok, F.col(column)),
    })


def repaired(lines: DataFrame, column: str = "value", position: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each line: the columns of ``keep``, ``error``, ``fixes``, ``source`` (the line) and the columns of a candidate.

    Containers that are missing or of another kind become empty, jobs without any readable field are left out, and
    years of experience (0 counts as missing), title and company follow from the jobs.  Completeness and a verified
    address (false) are filled in; the open-to-work flag never is.  A record without an id is named by its position
    if a column gives one, else by the hash of its line, so that equal lines have equal ids.  Other columns of
    ``lines`` are dropped, those of ``keep`` too if their names are taken here.  Lines that are blank or null, no JSON, or no object keep null in all candidate columns.
    What follows a whole value on its line is not looked at."""
    own = [F.col(c) for c in keep if c not in ("source", "error", "fixes", *CANDIDATE_COLUMNS)]
    kept = [*own, F.col(column).alias("source")] + ([F.col(position).cast("long").alias("_position")] if position else [])
    judged = _judged(lines, column).select(*kept, "error", "fixes", "_line")
    # a line that was turned away is read as an empty object, which costs nothing and keeps its row
    rows = from_json_lines(judged.withColumn("_read", F.coalesce("_line", F.lit("{}"))), "_read", keep=judged.columns)
    any_field = lambda j: ~F.forall(F.array(*(j[f].cast("string") for f in ("company", "title", "start_date", "end_date", "duration_months", "is_current",
                                    "industry", "company_size", "description"))), lambda x: x.isNull())
    rows = rows.withColumn("_jobs", F.filter("career_history", any_field))
    months = F.aggregate("_jobs", F.lit(0).cast("long"), lambda a, j: a + F.coalesce(j["duration_months"], F.lit(0)))
    now = F.coalesce(
        F.try_element_at(F.filter("_jobs", lambda j: F.coalesce(j["is_current"], F.lit(False))), F.lit(1)), F.try_element_at("_jobs", F.lit(1)))
    rows = rows.withColumns({"_months": months, "_now": now})
    p = lambda f: F.col(f"profile.{f}")
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    no_years = (F.coalesce(p("years_of_experience"), F.lit(0.0)) == 0) & (F.col("_months") != 0)
    no_title = absent(p("current_title")) & F.col("_now").isNotNull()
    no_company = no_title & absent(p("current_company"))
    # halves go to the even digit
    years = F.when(no_years, F.bround(F.col("_months") / 12, 1)).otherwise(p("years_of_experience"))
    title = F.when(no_title, F.coalesce("_now.title", F.lit(""))).otherwise(p("current_title"))
    company = F.when(no_company, F.coalesce("_now.company", F.lit(""))).otherwise(p("current_company"))
    new_id = F.concat(F.lit("CAND_"), F.lpad(F.col("_position").cast("string"), 7, "0")) if position else generated_id(F.col("_line"))
    no_id = absent(F.col("candidate_id"))
    has = lambda k: F.map_contains_key("signals", k)
    full = [~absent(p("summary")), ~absent(title), ~absent(p("location")), F.size("_jobs") > 0, F.size("skills") > 0]
    complete = F.lit(20) + 16 * sum((c.cast("int") for c in full), F.lit(0))
    filled = F.map_concat(
        F.map_filter(F.create_map(F.lit("profile_completeness_score"), complete.cast("string"), F.lit("verified_email"), F.lit("false")), lambda k, x: ~has(k)), "signals")
    more = F.array_compact(F.array(
        F.when(no_id, "id"), F.when(F.size("_jobs") < F.size("career_history"), "jobs"), F.when(no_years, "years"), F.when(no_title, "title"),
        F.when(no_company, "company"), F.when(~has("profile_completeness_score"), "completeness"), F.when(~has("verified_email"), "verified"),
    ))
    fine = F.col("error").isNull()
    return rows.select(
        *own, "source", "error", F.when(fine, F.concat("fixes", more)).otherwise(strings([])).alias("fixes"), *(F.when(fine, c).alias(name) for name, c in {
            "candidate_id": F.when(no_id, new_id).otherwise(F.col("candidate_id")),
            "profile": F.col("profile").withField("years_of_experience", years).withField("current_title", title).withField("current_company", company),
            "career_history": F.col("_jobs"), "education": F.col("education"), "skills": F.col("skills"), "signals": filled, "links": F.col("links"),
        }.items())
    )


def accepted(rows: DataFrame) -> DataFrame:
    """Candidate rows of the lines that could be read."""
    return rows.where("error is null").drop("source", "error", "fixes")


def rejected(rows: DataFrame) -> DataFrame:
    """(source, kind, detail) of the lines that were turned away."""
    return rows.where("error is not null").select("source", "error.kind", "error.detail")
