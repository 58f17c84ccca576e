"""The feature row of a candidate: texts, term lists, counts, flags and signals.

Texts are assembled in one projection and tokenised in a second, so that every token set is worked
out once a row.  Missing text counts as empty; a missing open-to-work flag stays null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import dates as dt
from meritlens.functions import lexicons as lx
from meritlens.functions import text as tx
from meritlens.sources.schema import signal, truthy


def _words(*parts: Column) -> Column:
    """Parts joined by single spaces, empty ones included."""
    return F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), " ")


def _jobs(*fields: str) -> Column:
    return F.array_join(F.transform("career_history", lambda j: _words(*(j[f] for f in fields))), " ")


def evidence_text(prefix: str = "") -> Column:
    """Summary, headline, each job's title and description, skills; no empty parts."""
    parts = F.concat(
        F.array(F.col("profile.summary"), F.col("profile.headline")),
        F.flatten(F.transform("career_history", lambda j: F.array(j["title"], j["description"]))),
        F.transform("skills", lambda s: s["name"]),
    )
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " ")


def evidence_blob() -> Column:
    """Lower-cased text for looking skills up in, separators as spaces."""
    own = _words(F.col("profile.summary"), F.col("profile.headline"), F.col("profile.current_title"))
    return F.regexp_replace(F.lower(_words(own, _jobs("title", "description"))), r"[/\-.]", " ")


def features(candidates: DataFrame) -> DataFrame:
    """``candidates`` with the feature columns."""
    skill_names = F.transform("skills", lambda s: s["name"])
    career = F.lower(_jobs("title", "company", "industry", "description"))
    profile = F.lower(_words(*(F.col(f"profile.{f}") for f in ("headline", "summary", "current_title", "current_industry"))))
    skill_text = F.lower(F.array_join(skill_names, " "))
    companies = F.transform("career_history", lambda j: tx.norm(j["company"]))
    expert_unused = F.size(
        F.filter("skills", lambda s: (tx.norm(s["proficiency"]) == "expert") & (F.coalesce(s["duration_months"], F.lit(0)) == 0))
    )
    scores = F.from_json(F.try_element_at("signals", F.lit("skill_assessment_scores")), "map<string,double>")
    number = lambda name, default: F.coalesce(signal(name), F.lit(float(default)))
    positive = lambda name, default: F.coalesce(F.nullif(signal(name), F.lit(0.0)), F.lit(float(default)))
    texts = candidates.withColumns({
        "title": F.coalesce("profile.current_title", F.lit("")),
        "title_norm": tx.norm("profile.current_title"),
        "years": F.coalesce("profile.years_of_experience", F.lit(0.0)),
        "location": F.coalesce("profile.location", F.lit("")),
        "country": F.coalesce("profile.country", F.lit("")),
        "current_industry": F.coalesce("profile.current_industry", F.lit("")),
        "skill_names": skill_names,
        "career_text": career,
        "skill_text": skill_text,
        "all_text": F.concat_ws(" ", profile, career, skill_text),
        "match_text": evidence_text(),
        "companies": companies,
        "expert_zero_duration": expert_unused,
        "skill_assessment_max": F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0)),
        "profile_completeness": number("profile_completeness_score", 0),
        "last_active_months": dt.months_since(F.try_element_at("signals", F.lit("last_active_date"))),
        "open_to_work": truthy("open_to_work_flag"),
        "response_rate": number("recruiter_response_rate", 0),
        "response_time_hours": positive("avg_response_time_hours", 999),
        "notice_period_days": number("notice_period_days", 0).cast("int"),
        "github_activity_score": number("github_activity_score", -1),
        "search_appearance_30d": number("search_appearance_30d", 0).cast("int"),
        "saved_by_recruiters_30d": number("saved_by_recruiters_30d", 0).cast("int"),
        "interview_completion_rate": number("interview_completion_rate", 0),
        "offer_acceptance_rate": number("offer_acceptance_rate", -1),
        "verified_email": F.coalesce(truthy("verified_email"), F.lit(False)),
        "verified_phone": F.coalesce(truthy("verified_phone"), F.lit(False)),
        "linkedin_connected": F.coalesce(truthy("linkedin_connected"), F.lit(False)),
        "willing_to_relocate": F.coalesce(truthy("willing_to_relocate"), F.lit(False)),
        "preferred_work_mode": F.coalesce(F.try_element_at("signals", F.lit("preferred_work_mode")), F.lit("")),
    })
    service = F.size(F.filter("companies", lambda c: c.isin(*lx.SERVICE_COMPANIES)))
    return texts.withColumns({
        "tokens": tx.token_set("all_text"),
        "career_tokens": tx.token_set("career_text"),
        "title_tokens": tx.token_set("title_norm"),
        "match_tokens": tx.token_set("match_text", tx.MATCH_TOKEN),
        "retrieval_terms": tx.contains_any("all_text", lx.RETRIEVAL_TERMS),
        "vector_terms": tx.contains_any("all_text", lx.VECTOR_TERMS),
        "ml_terms": tx.contains_any("all_text", lx.ML_TERMS),
        "eval_terms": tx.contains_any("all_text", lx.EVAL_TERMS),
        "production_terms": tx.contains_any("all_text", lx.PRODUCTION_TERMS),
        "shallow_ai_terms": tx.contains_any("all_text", lx.SHALLOW_AI_TERMS),
        "career_retrieval_terms": tx.contains_any("career_text", lx.RETRIEVAL_TERMS),
        "career_production_terms": tx.contains_any("career_text", lx.PRODUCTION_TERMS),
        "skill_retrieval_terms": tx.contains_any("skill_text", lx.RETRIEVAL_TERMS),
        "skill_vector_terms": tx.contains_any("skill_text", lx.VECTOR_TERMS),
        "skill_ml_terms": tx.contains_any("skill_text", lx.ML_TERMS),
        "title_relevance_terms": tx.contains_any("title_norm", {*lx.RETRIEVAL_TERMS, *lx.ML_TERMS}),
        "service_company_count": service,
        "product_company_count": F.size(F.filter("companies", lambda c: c.isin(*lx.PRODUCT_COMPANIES))),
        "service_only": (F.size("companies") > 0) & (service == F.size("companies")),
        "non_tech_title": F.col("title_norm").isin(*lx.NON_TECH_TITLES),
        "ai_title": F.col("title_norm").isin(*lx.AI_TITLES),
        "adjacent_title": F.col("title_norm").isin(*lx.ADJACENT_TITLES),
    })


def has_activity() -> Column:
    return (F.col("last_active_months") < 999) | (F.col("response_rate") > 0)


def insufficient_evidence() -> Column:
    """Nothing to assess: hardly any text, no title, no years."""
    return (F.length(F.trim("all_text")) < 3) & (F.trim("title") == "") & (F.col("years") == 0)
