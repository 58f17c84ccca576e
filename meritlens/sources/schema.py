"""The candidate record and null-safe access to its parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = """
candidate_id string,
profile struct<anonymized_name:string, headline:string, summary:string, location:string, country:string,
  years_of_experience:double, current_title:string, current_company:string, current_company_size:string,
  current_industry:string>,
career_history array<struct<company:string, title:string, start_date:string, end_date:string, duration_months:int,
  is_current:boolean, industry:string, company_size:string, description:string>>,
education array<struct<institution:string, degree:string, field_of_study:string, start_year:int, end_year:int,
  grade:string, tier:string>>,
skills array<struct<name:string, proficiency:string, endorsements:int, duration_months:int>>,
signals map<string,string>,
links array<string>
"""

#: Keys that records may hold their signals under; fixed values of the input format.
SIGNAL_KEYS = ("redrob_signals", "signals")
PROFILE_FIELDS = (
    "anonymized_name", "headline", "summary", "location", "country", "years_of_experience", "current_title",
    "current_company", "current_company_size", "current_industry",
)


def from_json_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Candidate rows from JSON text, one record each.

    Containers that are missing, null or of another kind become empty; a skill may be an object or
    a bare string; signals keep every field as JSON text, so their vocabulary is open.  The columns
    of ``lines`` named in ``keep`` come first."""
    v = F.try_parse_json(F.col(column))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    text = lambda path: get(path, "string")
    profile = F.struct(
        *(get(f"$.profile.{f}", "double" if f == "years_of_experience" else "string").alias(f) for f in PROFILE_FIELDS)
    )
    variants = lambda path: F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>"))
    # months may be fractions or text; what they hold beyond whole numbers is cut
    field = lambda x, name, kind: (
        F.try_variant_get(x, f"$.{name}", "double").try_cast("int") if name == "duration_months" else F.try_variant_get(x, f"$.{name}", kind)
    )
    inner = lambda x, fields: F.struct(*(field(x, name, kind).alias(name) for name, kind in fields))
    career = (
        ("company", "string"), ("title", "string"), ("start_date", "string"), ("end_date", "string"),
        ("duration_months", "int"), ("is_current", "boolean"), ("industry", "string"), ("company_size", "string"),
        ("description", "string"),
    )
    education = (
        ("institution", "string"), ("degree", "string"), ("field_of_study", "string"), ("start_year", "int"),
        ("end_year", "int"), ("grade", "string"), ("tier", "string"),
    )
    skill = (("name", "string"), ("proficiency", "string"), ("endorsements", "int"), ("duration_months", "int"))
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    skills = F.transform(
        variants("$.skills"),
        lambda x: F.when(
            is_text(x),
            F.struct(
                x.cast("string").alias("name"), F.lit(None).cast("string").alias("proficiency"),
                F.lit(None).cast("int").alias("endorsements"), F.lit(None).cast("int").alias("duration_months"),
            ),
        ).otherwise(inner(x, skill)),
    )
    signals = F.lit(None).cast("map<string,variant>")
    for key in SIGNAL_KEYS:
        signals = F.coalesce(signals, get(f"$.{key}", "map<string,variant>"))
    kept = F.map_filter(F.coalesce(signals, F.create_map().cast("map<string,variant>")), lambda k, x: ~F.is_variant_null(x))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return lines.where(v.isNotNull() & is_object).select(
        *keep,
        text("$.candidate_id").alias("candidate_id"),
        profile.alias("profile"),
        F.transform(variants("$.career_history"), lambda x: inner(x, career)).alias("career_history"),
        F.transform(variants("$.education"), lambda x: inner(x, education)).alias("education"),
        F.filter(skills, lambda s: F.coalesce(s["name"], F.lit("")) != "").alias("skills"),
        F.transform_values(kept, lambda k, x: F.coalesce(x.cast("string"), F.to_json(x))).alias("signals"),
        F.coalesce(get("$.links", "array<string>"), F.array().cast("array<string>")).alias("links"),
    )


def signal(name: str, kind: str = "double") -> Column:
    """One signal field as a typed value, null if absent or of another kind."""
    return F.try_element_at("signals", F.lit(name)).try_cast(kind)


def truthy(name: str) -> Column:
    """A flag as Python would read it: null if absent, false for false, 0 and empty."""
    raw = F.try_element_at("signals", F.lit(name))
    return F.when(raw.isNotNull(), ~F.lower(raw).isin("false", "", "0", "0.0", "{}", "[]"))


def generated_id(seed: Column) -> Column:
    """CAND_ and 15 digits: the seed's SHA-256 modulo 10**15, worked out 32 bits at a time."""
    digest = F.sha2(seed, 256)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("decimal(20,0)"))
    rest = F.aggregate(
        pieces,
        F.lit(0).cast("decimal(20,0)"),
        lambda r, x: F.pmod(r * F.lit(1 << 32).cast("decimal(11,0)") + x, F.lit(10**15).cast("decimal(16,0)")).cast("decimal(20,0)"),
    )
    return F.concat(F.lit("CAND_"), F.lpad(rest.cast("string"), 15, "0"))
