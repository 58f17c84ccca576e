"""The two scoring paths: lexical and hybrid.  Both end in the same gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.operators import audits
from meritlens.operators.features import has_activity, insufficient_evidence
from meritlens.operators.jobs import AI_CATEGORY, Job, job_of  # noqa: F401  the category is used by callers
from meritlens.operators.requirements import Spec

NO_DATA = "the record has too little in it to assess"


def logistics(spec: Spec | Job) -> Column:
    job = job_of(spec)
    city = F.exists(job.cities, lambda c: F.contains(F.lower("location"), c))
    return sc.clamp(
        F.when(F.lower("country") == job.country, 0.55).otherwise(0.15)
        + F.when(city, 0.25).otherwise(0.0)
        + F.when(F.col("willing_to_relocate"), 0.15).otherwise(0.0)
        + F.when(F.col("preferred_work_mode").isin("hybrid", "flexible"), 0.05).otherwise(0.0)
    )


def behavioral() -> Column:
    months, notice = F.col("last_active_months"), F.col("notice_period_days")
    flag = lambda c: F.when(F.col(c), 1.0).otherwise(0.0)
    mix = (
        0.18 * (F.col("profile_completeness") / 100.0)
        + 0.20 * sc.recency_factor(months)
        + 0.12 * sc.open_term(F.col("open_to_work"), months)
        + 0.20 * F.col("response_rate")
        + 0.08 * sc.clamp(1.0 - F.col("response_time_hours") / 240.0)
        + 0.10 * sc.steps(notice, (30, 1.0), (60, 0.7), (90, 0.35), otherwise=0.15)
        + 0.06 * sc.clamp(F.col("interview_completion_rate"))
        + 0.03 * flag("verified_email")
        + 0.03 * flag("verified_phone")
    )
    silent = ~has_activity() & (notice == 0) & (F.col("profile_completeness") == 0)
    return F.when(silent, 0.5).otherwise(sc.clamp(mix))


def trust() -> Column:
    tier = lambda c, hi, a, lo, b: F.when(F.col(c) >= hi, a).when(F.col(c) >= lo, b).otherwise(0.0)
    return sc.clamp(
        F.when(F.col("linkedin_connected"), 0.22).otherwise(0.0)
        + tier("github_activity_score", 40, 0.18, 10, 0.10)
        + tier("saved_by_recruiters_30d", 10, 0.18, 4, 0.10)
        + tier("search_appearance_30d", 150, 0.18, 60, 0.10)
        + tier("offer_acceptance_rate", 0.5, 0.14, 0, 0.06)
        + F.when(F.col("skill_assessment_max") >= 70, 0.10).otherwise(0.0)
    )


def coverages(rows: DataFrame, job: Job) -> DataFrame:
    """Feature rows with the coverage of the spec's texts."""
    return rows.withColumns({
        "must_cov": job.coverage("tokens", "must"),
        "nice_cov": job.coverage("tokens", "nice"),
        "career_must": job.coverage("career_tokens", "must"),
        "career_nice": job.coverage("career_tokens", "nice"),
        "title_cov": job.coverage("title_tokens", "title"),
        "disq_cov": job.coverage("tokens", "disqualifiers"),
    })


def technical(job: Job) -> Column:
    n = lambda c: F.size(F.col(c))
    capped = lambda c, step, most: F.least(F.lit(most), step * n(c))
    base = job.pick(
        job.ai,
        lambda: (
            capped("career_retrieval_terms", 0.07, 0.28) + capped("vector_terms", 0.045, 0.18) + capped("eval_terms", 0.04, 0.16)
            + capped("career_production_terms", 0.045, 0.18) + capped("ml_terms", 0.015, 0.12)
            + 0.12 * F.col("must_cov") + 0.04 * F.col("nice_cov")
        ),
        lambda: (
            0.48 * F.col("must_cov") + 0.24 * F.col("career_must") + 0.12 * F.col("nice_cov") + 0.08 * F.col("career_nice")
            + F.when(n("career_production_terms") > 0, 0.08).otherwise(0.0)
        ),
    )
    best = F.col("skill_assessment_max")
    return sc.clamp(base + F.when(best >= 70, 0.08).when(best >= 50, 0.04).otherwise(0.0))


def career(job: Job) -> Column:
    has = lambda c: F.size(F.col(c)) > 0
    give = lambda c, x: F.when(c, x).otherwise(0.0)
    industry = F.lower("current_industry")
    base = job.pick(
        job.ai,
        lambda: (
            F.when(F.col("ai_title"), 0.32).when(F.col("adjacent_title"), 0.18).otherwise(0.0)
            + give(has("career_retrieval_terms"), 0.16) + give(has("career_production_terms"), 0.12)
            - give(F.col("non_tech_title") & ~has("career_retrieval_terms"), 0.18)
            - give(F.col("service_only") & (F.col("product_company_count") == 0), 0.12)
        ),
        lambda: (
            0.22 * F.col("title_cov") + 0.24 * F.col("career_must") + 0.10 * F.col("career_nice")
            + give(has("career_production_terms"), 0.10)
        ),
    )
    named = F.contains(industry, F.lit("hr")) | F.contains(industry, F.lit("ai")) | F.contains(industry, F.lit("software"))
    return sc.clamp(
        base + give(F.col("product_company_count") > 0, 0.18) + 0.12 * F.col("career_must") + 0.04 * F.col("career_nice") + give(named, 0.10)
    )


def lexical_relevance(job: Job) -> Column:
    must, title, nice = F.col("must_cov"), F.col("title_cov"), F.col("nice_cov")
    return job.pick(
        job.has_must,
        lambda: sc.clamp(F.greatest(F.col("career_must"), 0.85 * must, 0.5 * title) + 0.10 * nice),
        lambda: sc.clamp(F.greatest(must, title, 0.5 * nice, F.lit(0.4))),
    )


def _finish(rows: DataFrame, job: Job, engine: str) -> DataFrame:
    """From the parts to the final score, eligibility and rounded columns."""
    none = F.col("no_evidence")
    parts = {k: F.col(k) for k in sc.GENERIC}
    gated = rows.withColumn("role_relevance", F.when(none, 0.0).otherwise(F.col("role_relevance"))).withColumns({
        "general_quality": sc.quality(parts, job.weights, job.total),
        "risk_flags": F.when(none, F.array_append("risk_flags", F.lit("insufficient_evidence"))).otherwise(F.col("risk_flags")),
    })
    scored = gated.withColumns({
        "final_score": sc.gate(F.col("role_relevance"), F.col("general_quality"), sc.clamp(1.0 - F.col("soft_penalty"), 0.6), ~F.col("vetoed")),
        "top10_eligible": ~F.col("vetoed") & (F.col("role_relevance") >= 0.34) & ~none,
        "penalty": F.when(F.col("vetoed"), 1.0).otherwise(F.col("soft_penalty")),
        "confidence": F.when(none, 0.0).otherwise(sc.clamp(F.col("confidence_parts") + 0.05 * (F.size("risk_flags") == 0).cast("int"))),
        "engine": F.lit(engine),
        "reach": sc.reachability(F.col("last_active_months"), F.col("response_rate"), F.col("open_to_work")),
    })
    rounded = ("final_score", *lx.FACTORS, "confidence", "penalty", "role_relevance", "general_quality", "requirement_coverage")
    return scored.withColumns({c: sc.rounded(F.col(c), 6) for c in rounded}).drop("soft_penalty", "confidence_parts", "no_evidence")


def score_lexical(rows: DataFrame, spec: Spec | Job) -> DataFrame:
    """Audited feature rows scored by token coverage, for one job or for the job that stands in each row."""
    job = job_of(spec)
    covered = coverages(rows, job).withColumn("risks", audits.risk_flags())
    loose = (F.col("disq_cov") >= 0.34) & (F.col("must_cov") < 0.34)
    soft = (
        sc.risk_penalty(F.col("risks")) + F.when(loose, 0.06).otherwise(0.0)
        + F.when(F.col("impossible"), 0.0).otherwise(F.col("audit_penalty"))
    )
    relevance = lexical_relevance(job)
    none = insufficient_evidence()
    grounded = F.when(F.size("career_production_terms") > 0, 0.10).otherwise(0.0)
    scored = covered.withColumns({
        "technical_evidence": technical(job),
        "career_fit": career(job),
        "seniority": sc.seniority(F.col("years"), job.preferred, job.strongest),
        "logistics": logistics(job),
        "behavioral": behavioral(),
        "trust": trust(),
        "role_relevance": relevance,
        "soft_penalty": soft,
        "vetoed": F.col("impossible"),
        "risk_flags": F.array_union("risks", "codes"),
        "no_evidence": none,
        "requirement_coverage": F.col("must_cov"),
        "semantic_fit": F.lit(0.0),
        "lexical_fit": F.lit(0.0),
        "confidence_parts": 0.6 * relevance + 0.25 * F.col("career_must") + grounded,
        "concern_notes": F.when(none, F.array(F.lit(NO_DATA))).otherwise(F.array().cast("array<string>")),
    })
    return _finish(scored.drop("risks"), job, "spine")


def score_hybrid(rows: DataFrame, spec: Spec) -> DataFrame:
    """Audited feature rows with ``matches``, ``fit`` and ``schema_signals`` scored by requirement matches."""
    career_lexical = tx.term_coverage("career_tokens", spec.must)
    covered = rows.withColumn("career_lexical", career_lexical)
    fit = lambda k: F.col(f"fit.{k}")
    signal = lambda k: F.col(f"schema_signals.{k}")
    disqualified = fit("disqualifier") >= 0.5
    if spec.must:
        relevance = sc.clamp(0.55 * fit("semantic_fit") + 0.30 * fit("coverage") + 0.15 * F.col("career_lexical"))
    else:
        relevance = sc.clamp(F.greatest(fit("semantic_fit"), F.lit(0.4)))
    none = insufficient_evidence()
    details = F.slice(F.transform("consistency", lambda f: f["detail"]), 1, 3)
    scored = covered.withColumns({
        "technical_evidence": sc.clamp(0.80 * fit("semantic_fit") + 0.20 * fit("lexical_fit")),
        "career_fit": sc.clamp(
            0.55 * fit("coverage") + 0.20 * F.col("career_lexical") + 0.15 * fit("semantic_fit")
            + F.when(F.col("product_company_count") > 0, 0.10).otherwise(0.0)),
        "seniority": sc.seniority(F.col("years"), spec.preferred, spec.strongest),
        "logistics": logistics(spec),
        "behavioral": sc.clamp(0.34 * signal("availability") + 0.33 * signal("engagement") + 0.33 * behavioral()),
        "trust": sc.clamp(0.5 * trust() + 0.5 * signal("trust")),
        "role_relevance": relevance,
        "soft_penalty": F.col("audit_penalty") + F.when(disqualified & (fit("coverage") >= 0.5), 0.20).otherwise(0.0),
        "vetoed": F.col("impossible") | (disqualified & (fit("coverage") < 0.5)),
        "risk_flags": F.when(disqualified, F.array_append("codes", F.lit("semantic_disqualifier_overlap"))).otherwise(F.col("codes")),
        "disqualifier_hits": F.transform(
            F.filter("matches", lambda m: (m["kind"] == lx.DISQUALIFIER) & (m["score"] >= 0.5)), lambda m: m["text"]),
        "no_evidence": none,
        "requirement_coverage": fit("coverage"),
        "semantic_fit": sc.rounded(fit("semantic_fit"), 6),
        "lexical_fit": sc.rounded(fit("lexical_fit"), 6),
        "confidence_parts": 0.50 * relevance + 0.20 * fit("coverage")
        + F.when(F.col("career_lexical") >= 0.34, 0.15).otherwise(0.0) + 0.10 * signal("engagement"),
        "concern_notes": F.when(none, F.slice(F.array_prepend(details, F.lit(NO_DATA)), 1, 3)).otherwise(details),
    })
    return _finish(scored, job_of(spec), "hybrid")
