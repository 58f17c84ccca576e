"""Consistency flags and risk flags of a feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import dates as dt
from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.operators.features import evidence_blob
from meritlens.sources.schema import signal


def _flag(code: str, detail: Column, severity: Column | float) -> Column:
    severity = F.lit(severity) if isinstance(severity, float) else severity
    return F.struct(F.lit(code).alias("code"), detail.alias("detail"), severity.alias("severity"))


def tenure_exceeds(years: Column, months: Column) -> Column:
    """More months of tenure than the stated years allow, overlaps granted."""
    return (years > 0) & (months > years * 12 + F.greatest(F.lit(18), F.floor(years * 6)))


def skill_exceeds(years: Column, months: Column) -> Column:
    return (years > 0) & (months > years * 30 + 12)


def consistency_flags() -> Column:
    """array<struct<code, detail, severity>> over the columns of a feature row."""
    return sc.once(F.filter("skills", lambda s: tx.norm(s["proficiency"]) == "expert"), _flags_of)


def _flags_of(experts: Column) -> Column:
    years = F.col("years")
    months = F.aggregate("career_history", F.lit(0), lambda a, j: a + F.coalesce(j["duration_months"], F.lit(0)))
    unused = F.filter(experts, lambda s: s["duration_months"] == 0)
    longest = F.coalesce(F.array_max(F.transform("skills", lambda s: F.coalesce(s["duration_months"], F.lit(0)))), F.lit(0))
    bad_job = F.get(
        F.filter("career_history", lambda j: dt.is_future(j["start_date"]) | dt.date_before(j["end_date"], j["start_date"])), F.lit(0)
    )
    words = lambda s: F.filter(F.split(F.lower(s["name"]), r"[\s/\-.]+"), lambda w: F.length(w) >= 3)
    unnamed = lambda blob: F.filter(experts, lambda s: sc.once(words(s), lambda own: (F.size(own) > 0) & ~F.exists(own, lambda w: F.contains(blob, w))))
    ghosts = sc.once(evidence_blob(), unnamed)
    names = lambda c: F.array_join(F.slice(F.transform(c, lambda s: s["name"]), 1, 3), ", ")
    scores = F.from_json(F.try_element_at("signals", F.lit("skill_assessment_scores")), "map<string,double>")
    assessed = F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))
    endorsed = F.coalesce(signal("endorsements_received"), F.lit(0.0))
    say = F.format_string
    return F.array_compact(F.array(
        F.when(tenure_exceeds(years, months), _flag(
            "tenure_exceeds_experience", say("%.1f years stated, %d months of tenure listed", years, months), 0.30)),
        F.when(F.size(unused) > 0, _flag(
            "expert_zero_duration", F.concat(F.lit("expert level with no months of use: "), names(unused)),
            F.when(F.size(unused) >= 2, 0.25).otherwise(0.15))),
        F.when(skill_exceeds(years, longest), _flag(
            "skill_exceeds_career", say("one skill has %d months, experience is %.1f years", longest, years), 0.20)),
        F.when(bad_job.isNotNull(), _flag(
            "date_integrity", F.concat_ws(" to ", F.lit("dates do not fit:"), bad_job["start_date"], bad_job["end_date"]), 0.15)),
        F.when((F.size(experts) >= 5) & (F.size(ghosts) == F.size(experts)), _flag(
            "skill_not_in_evidence", F.concat(F.lit("no expert skill appears in the record's text: "), names(ghosts)), 0.10)),
        F.when((F.size(experts) > 0) & (endorsed == 0) & (assessed == 0), _flag(
            "endorsement_inconsistency", F.lit("expert skills without endorsements or assessments"), 0.08)),
    ))


def risk_flags() -> Column:
    """Names of the risks of a feature row."""
    n = lambda c: F.size(F.col(c))
    grounded = n("career_retrieval_terms") > 0
    months = F.col("last_active_months")
    return sc.present(
        (F.col("non_tech_title") & (n("ml_terms") >= 4) & ~grounded, "non_tech_ai_keyword_stuffing"),
        ((n("ml_terms") >= 6) & ~grounded, "ai_terms_without_career_evidence"),
        (F.col("expert_zero_duration") >= 2, "expert_skills_zero_duration"),
        (F.col("service_only") & (F.col("product_company_count") == 0) & ~grounded, "service_only_without_product_search_evidence"),
        ((months >= 6) & (months < 999) & (F.col("response_rate") < 0.2), "stale_low_response"),
        ((n("shallow_ai_terms") > 0) & ~grounded, "shallow_ai_tool_interest"),
    )


def audited(rows: DataFrame) -> DataFrame:
    """Feature rows with ``consistency``, ``codes``, ``audit_penalty`` and ``impossible``."""
    flagged = rows.withColumn("consistency", consistency_flags())
    codes = F.transform("consistency", lambda f: f["code"])
    penalty = sc.rounded(F.least(F.lit(0.6), F.aggregate("consistency", F.lit(0.0), lambda a, f: a + f["severity"])), 4)
    return flagged.withColumns(
        {"codes": codes, "audit_penalty": penalty, "impossible": F.arrays_overlap(codes, tx.strings(lx.IMPOSSIBLE_CODES))}
    )
