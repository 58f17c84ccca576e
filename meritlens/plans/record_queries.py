"""Registered queries over candidate records: features, audits, signals and both scoring paths.

Records are made from ``documents``: the text is the summary, everything else follows from doc_id by
expressions that both engines read (:data:`FIELDS`), so that each rule of each operator meets rows on
either side of it.  The SQL works the operators out on flat columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.operators import adversarial, audits, explain, matching, profiling, ranking, requirements, scoring, signals, validation
from meritlens.operators.features import features, has_activity, insufficient_evidence
from meritlens.plans import engine
from meritlens.plans.driver_queries import _clamp_sql, _coverage_sql, _list, _telling_sql, _tokens_sql, query, read
from meritlens.sources import repair, resume_columns
from meritlens.sources.schema import CANDIDATE


def _pick(*values: str | None) -> str:
    """One of the values by doc_id."""
    shown = ["NULL" if v is None else "'" + v + "'" for v in values]
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown)) + " END"


def _number(of: int, scale: int = 1, shift: int = 0) -> str:
    return f"CAST(doc_id % {of} - {shift} AS DOUBLE) / CAST({scale} AS DOUBLE)"


SKILL_NAMES = (
    ("Python", "FAISS", "Excel", "Kafka", "Spark", "Go", "NLP"), ("Bookkeeping", "Ranking", "thing", "LoRA"),
    ("Terraform", "able", "PyTorch"), ("Qdrant", "Figma", "and", "C++", "Redis"), ("Salesforce", "tion of", "xyzzy"),
)
PLAIN = {
    "title": _pick("Search Engineer", "Data Engineer", "Accountant", "AI Engineer", "Content Writer", "Research Scientist", "", "Software Engineer"),
    "headline": _pick("machine learning and search", "in production with python", "llm rag nlp lora python ai tools chatgpt", "the thin er", ""),
    "location": _pick("Pune", "Berlin", "Remote", "Noida West", "Paris"), "country": _pick("India", "Germany", "France"),
    "industry": _pick("AI software", "Retail", "HR tech", "Banking", "", "Travel"),
    "title1": _pick("Search Engineer", "Clerk", "Developer"), "company1": _pick("TCS", "Swiggy", "Acme", "Infosys", "Zoho", "", "Wipro"),
    "industry1": _pick("IT", "Retail"), "title2": _pick("Analyst", "Engineer"), "company2": _pick("Infosys", "Cred", "HCL", "Beta", "TCS"),
    "industry2": _pick("IT", "Food", "Media"), "about2": _pick("reports", "recommendation models for search", "the thing"),
    "about1": _pick("built retrieval and ranking, shipped to production with low latency", "kept the books", "embeddings with faiss, ndcg and recall",
                    "the and ing thing from was", "deployed a monitoring pipeline", ""),
    "start1": _pick("2019-03-01", "2026-09-01", "2020-01-01", "2015-06-01", "2018-02-01", "", "2021-11-01", "2016-04-01", "2017-05-01"),
    "end1": _pick(None, "2018-01-01", "2024-05-01", "2022-02-01", "2021-07-01"),
}
SIGNALS = {
    "profile_completeness_score": "CAST(doc_id % 101 AS STRING)",
    "last_active_date": _pick("2026-06-01", "2026-05-20", "2026-02-11", None, "2025-08-30", "2026-04-14", "2024-01-01"),
    "open_to_work_flag": _pick("true", "false", None), "recruiter_response_rate": _pick("0.1", "0.45", "0.15", "0.9", None, "0.3", "0.05"),
    "avg_response_time_hours": "CAST(doc_id % 300 AS STRING)", "notice_period_days": _pick("0", "30", "45", "90", "120"),
    "github_activity_score": "CAST(doc_id % 103 - 2 AS STRING)", "search_appearance_30d": "CAST(doc_id % 211 AS STRING)",
    "saved_by_recruiters_30d": "CAST(doc_id % 17 AS STRING)", "interview_completion_rate": _pick("1.0", "0.5", "0.75", None),
    "offer_acceptance_rate": _pick("0.5", "-1", "0.2", "0.8"), "verified_email": _pick("true", "false"), "verified_phone": _pick("true", "false", "true"),
    "linkedin_connected": _pick("true", "false", "false", "true", None), "willing_to_relocate": _pick("false", "true"),
    "preferred_work_mode": _pick("hybrid", "onsite", "flexible", "remote"), "endorsements_received": _pick("0", "12", "140"),
    "skill_assessment_scores": _pick('{"python": 75}', '{"sql": 55}', None, '{"go": 20}'),
}
YEARS = _number(150, 10)
MONTHS = ("CAST(doc_id % 97 AS INT)", "CAST(doc_id % 61 AS INT)")
LEVELS = [f"CASE WHEN doc_id % {k + 7} = 0 THEN 'intermediate' ELSE 'expert' END" for k in range(5)]
USES = [f"CAST(doc_id % {11 * k + 9} * {k + 1} AS INT)" for k in range(5)]
NAMES = [_pick(*names) for names in SKILL_NAMES]

SPEC = requirements.Spec(
    "search", "Search Engineer", "ai_ml_search_ranking", (5.0, 9.0), (6.0, 8.0), ("Pune", "Noida"), "India",
    requirements._listed(("retrieval and ranking", "python", "the and ing", "vector search"), ("embeddings", "tion of"), ("kept the books",)),
    requirements.weights_of("ai_ml_search_ranking"),
)
OTHER = requirements.Spec(
    "backend", "Software Engineer", "backend_engineering", (4.0, 8.0), (5.0, 7.0), ("Berlin",), "Germany",
    requirements._listed(("data pipeline", "kafka", "monitoring"), ("terraform",), ("ai tools",)), requirements.weights_of("backend_engineering"),
)
EMBEDDED = [[((k * (r + 3)) % 11 - 5) / 10 for k in range(64)] for r in range(len(SPEC.requirements))]


def records(spark, sf) -> DataFrame:
    """Candidate records, one for each document."""
    e = F.expr
    text = lambda k: e(PLAIN[k])
    none = F.lit(None).cast("string")
    profile = {
        "anonymized_name": none, "headline": text("headline"), "summary": F.coalesce("text", F.lit("")), "location": text("location"), "country": text("country"),
        "years_of_experience": e(YEARS), "current_title": text("title"), "current_company": none, "current_company_size": none, "current_industry": text("industry"),
    }

    def job(n: int) -> Column:
        dates = {"start_date": text("start1"), "end_date": text("end1")} if n == 1 else {"start_date": none, "end_date": none}
        own = {"company": text(f"company{n}"), "title": text(f"title{n}"), **dates, "duration_months": e(MONTHS[n - 1]), "is_current": F.lit(False),
               "industry": text(f"industry{n}"), "company_size": none, "description": text(f"about{n}")}
        return F.struct(*(c.alias(k) for k, c in own.items()))

    skill = lambda k: F.struct(e(NAMES[k]).alias("name"), e(LEVELS[k]).alias("proficiency"), F.lit(0).alias("endorsements"), e(USES[k]).alias("duration_months"))
    told = F.create_map(*(x for k, v in SIGNALS.items() for x in (F.lit(k), e(v))))
    made = read(spark, sf, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("candidate_id"), F.struct(*(c.alias(k) for k, c in profile.items())).alias("profile"),
        F.array(job(1), job(2)).alias("career_history"), F.array().alias("education"), F.array(*map(skill, range(5))).alias("skills"),
        F.map_filter(told, lambda k, v: v.isNotNull()).alias("signals"), F.array().alias("links"),
    )
    schema = spark.createDataFrame([], CANDIDATE).schema
    return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _audited(spark, sf) -> DataFrame:
    return audits.audited(features(records(spark, sf)))


def _spine(rows: DataFrame) -> DataFrame:
    return scoring.score_lexical(audits.audited(features(rows)), SPEC)


# The same in SQL.

_TERMS = {
    "retrieval_terms": ("all_text", lx.RETRIEVAL_TERMS), "vector_terms": ("all_text", lx.VECTOR_TERMS), "ml_terms": ("all_text", lx.ML_TERMS),
    "eval_terms": ("all_text", lx.EVAL_TERMS), "production_terms": ("all_text", lx.PRODUCTION_TERMS), "shallow_ai_terms": ("all_text", lx.SHALLOW_AI_TERMS),
    "career_retrieval_terms": ("career_text", lx.RETRIEVAL_TERMS), "career_production_terms": ("career_text", lx.PRODUCTION_TERMS),
    "skill_retrieval_terms": ("skill_text", lx.RETRIEVAL_TERMS), "skill_vector_terms": ("skill_text", lx.VECTOR_TERMS), "skill_ml_terms": ("skill_text", lx.ML_TERMS),
}


def _features_sql(**changes: str) -> str:
    """Flat feature rows; ``changes`` replace fields or add to the skills."""
    fields = {"summary": "coalesce(text, '')", **PLAIN, "years": YEARS, "months1": MONTHS[0], "months2": MONTHS[1]}
    more = changes.pop("more_skills", "")
    fields |= changes
    listed = lambda values, extra: f"list_concat([{', '.join(values)}], {extra or '[]'})"
    names = listed(NAMES, more)
    levels = listed(LEVELS, more and f"list_transform({more}, lambda x: 'expert')")
    uses = listed(USES, more and f"list_transform({more}, lambda x: 0)")
    base = ", ".join(f"{v} AS {k}" for k, v in fields.items()) + ", " + ", ".join(f"{v} AS s_{k}" for k, v in SIGNALS.items())
    texts = f"""SELECT *, lower(title1 || ' ' || company1 || ' ' || industry1 || ' ' || about1 || ' ' || title2 || ' ' || company2 || ' ' || industry2 || ' ' || about2) AS career_text,
      lower(array_to_string(names, ' ')) AS skill_text, [lower(trim(company1)), lower(trim(company2))] AS companies,
      array_to_string(list_filter(list_concat([summary, headline, title1, about1, title2, about2], names), lambda x: x <> ''), ' ') AS match_text,
      replace(replace(replace(lower(summary || ' ' || headline || ' ' || title || ' ' || title1 || ' ' || about1 || ' ' || title2 || ' ' || about2), '/', ' '), '-', ' '), '.', ' ') AS blob,
      list_filter(list_zip(names, levels, uses), lambda s: s[2] = 'expert') AS experts, list_max(uses) AS longest, lower(trim(title)) AS title_norm
      FROM (SELECT doc_id, {base}, {names} AS names, {levels} AS levels, {uses} AS uses FROM documents)"""
    whole = f"SELECT *, lower(headline || ' ' || summary || ' ' || title || ' ' || industry) || ' ' || career_text || ' ' || skill_text AS all_text FROM ({texts})"
    number = lambda k, other: f"coalesce(s_{k}::DOUBLE, {other}::DOUBLE)"
    flag = lambda k: f"coalesce(s_{k} = 'true', false)"
    terms = ", ".join(f"len(list_filter({_list(values)}, lambda t: contains({c}, t))) AS {k}" for k, (c, values) in _TERMS.items())
    service = f"len(list_filter(companies, lambda c: list_contains({_list(lx.SERVICE_COMPANIES)}, c)))"
    day = "s_last_active_date::DATE"
    raw = f"(2026 - year({day})) * 12 + 6 - month({day}) - (CASE WHEN 14 < day({day}) THEN 1 ELSE 0 END)"
    assessed = "coalesce(regexp_extract(s_skill_assessment_scores, '([0-9]+)', 1)::DOUBLE, 0.0)"
    return f"""SELECT *, {_tokens_sql('all_text')} AS tokens, {_tokens_sql('career_text')} AS career_tokens, {_tokens_sql('title_norm')} AS title_tokens,
      {_tokens_sql('match_text', '[a-z0-9+#./-]{3,}')} AS match_tokens, {terms}, {service} AS service_count,
      len(list_filter(companies, lambda c: list_contains({_list(lx.PRODUCT_COMPANIES)}, c))) AS product_count, {service} = 2 AS service_only,
      list_contains({_list(lx.NON_TECH_TITLES)}, title_norm) AS non_tech_title, list_contains({_list(lx.AI_TITLES)}, title_norm) AS ai_title,
      list_contains({_list(lx.ADJACENT_TITLES)}, title_norm) AS adjacent_title, len(list_filter(experts, lambda s: s[3] = 0)) AS expert_zero,
      {assessed} AS best, CASE WHEN {day} IS NULL THEN 999 ELSE greatest(0, {raw}) END AS months, {number('recruiter_response_rate', '0')} AS rate,
      (CASE s_open_to_work_flag WHEN 'true' THEN true WHEN 'false' THEN false END) AS open,
      {number('profile_completeness_score', '0')} AS complete, CASE WHEN s_avg_response_time_hours = '0' THEN 999.0 ELSE {number('avg_response_time_hours', '999')} END AS hours,
      {number('notice_period_days', '0')} AS notice, {number('github_activity_score', '-1')} AS github, {number('search_appearance_30d', '0')} AS appearance,
      {number('saved_by_recruiters_30d', '0')} AS saved, {number('interview_completion_rate', '0')} AS interviews, {number('offer_acceptance_rate', '-1')} AS offers,
      {number('endorsements_received', '0')} AS endorsed, {flag('verified_email')} AS email, {flag('verified_phone')} AS phone, {flag('linkedin_connected')} AS linked,
      {flag('willing_to_relocate')} AS relocates FROM ({whole})"""


_GHOST_SQL = (
    "list_filter(experts, lambda s: len(list_filter(regexp_split_to_array(lower(s[1]), '[\\s/.-]+'), lambda w: length(w) >= 3)) > 0 AND "
    "len(list_filter(regexp_split_to_array(lower(s[1]), '[\\s/.-]+'), lambda w: length(w) >= 3 AND contains(blob, w))) = 0)"
)
_AUDIT_RULES = (
    ("tenure_exceeds_experience", "years > 0 AND months1 + months2 > years * 12 + greatest(18, floor(years * 6))", "0.3"),
    ("expert_zero_duration", "expert_zero > 0", "CASE WHEN expert_zero >= 2 THEN 0.25 ELSE 0.15 END"),
    ("skill_exceeds_career", "years > 0 AND longest > years * 30 + 12", "0.2"),
    ("date_integrity", "coalesce(left(nullif(start1, ''), 7) > '2026-06', false) OR coalesce(nullif(start1, '') > end1, false)", "0.15"),
    ("skill_not_in_evidence", f"len(experts) >= 5 AND len({_GHOST_SQL}) = len(experts)", "0.1"),
    ("endorsement_inconsistency", "len(experts) > 0 AND endorsed = 0 AND best = 0", "0.08"),
)
_RISK_RULES = (
    ("non_tech_ai_keyword_stuffing", "non_tech_title AND ml_terms >= 4 AND career_retrieval_terms = 0"),
    ("ai_terms_without_career_evidence", "ml_terms >= 6 AND career_retrieval_terms = 0"),
    ("expert_skills_zero_duration", "expert_zero >= 2"),
    ("service_only_without_product_search_evidence", "service_only AND product_count = 0 AND career_retrieval_terms = 0"),
    ("stale_low_response", "months >= 6 AND months < 999 AND rate < 0.2"),
    ("shallow_ai_tool_interest", "shallow_ai_terms > 0 AND career_retrieval_terms = 0"),
)


def _named(rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {r[1]} THEN '{r[0]}' END" for r in rules) + "], lambda x: x IS NOT NULL)"


def _audited_sql(**changes: str) -> str:
    penalty = " + ".join(f"(CASE WHEN {rule} THEN ({severity})::DOUBLE ELSE 0.0::DOUBLE END)" for _, rule, severity in _AUDIT_RULES)
    weights = " + ".join(f"(CASE WHEN {rule} THEN {lx.RISK_PENALTIES[name]}::DOUBLE ELSE 0.0::DOUBLE END)" for name, rule in _RISK_RULES)
    return f"""SELECT *, list_has_any(codes, {_list(lx.IMPOSSIBLE_CODES)}) AS impossible FROM (SELECT *, {_named(_AUDIT_RULES)} AS codes,
      round(least(0.6::DOUBLE, {penalty}), 4) AS audit_penalty, {_named(_RISK_RULES)} AS risks, least(0.45::DOUBLE, {weights}) AS risk_penalty,
      length(trim(all_text)) < 3 AND trim(title) = '' AND years = 0 AS none FROM ({_features_sql(**changes)}))"""


def _units(x: str, scale: int = 10000) -> str:
    return f"floor(({x}) * {scale}::DOUBLE + 0.5::DOUBLE)::BIGINT"


def units(c: Column, scale: int = 10000) -> Column:
    return F.floor(c * float(scale) + 0.5).cast("long")


def _id() -> Column:
    return F.col("candidate_id").cast("long").alias("doc_id")


_FLAGS = ("service_only", "non_tech_title", "ai_title", "adjacent_title")


@query("q43_feature_row", f"""
SELECT doc_id, len(tokens)::INTEGER AS n_tokens, len(career_tokens)::INTEGER AS n_career, len(match_tokens)::INTEGER AS n_match, {', '.join(f'{k}::INTEGER AS {k}' for k in _TERMS)},
  service_count::INTEGER AS service, product_count::INTEGER AS product, {', '.join(_FLAGS)}, expert_zero::INTEGER AS expert_zero, best::INTEGER AS best,
  months::INTEGER AS months, length(trim(all_text)) < 3 AND trim(title) = '' AND years = 0 AS none, months < 999 OR rate > 0 AS active FROM ({_features_sql()})""")
def q43(spark, sf):
    size = lambda c, k: F.size(c).alias(k)
    return features(records(spark, sf)).select(
        _id(), size("tokens", "n_tokens"), size("career_tokens", "n_career"), size("match_tokens", "n_match"), *(size(k, k) for k in _TERMS),
        F.col("service_company_count").alias("service"), F.col("product_company_count").alias("product"), *_FLAGS, F.col("expert_zero_duration").alias("expert_zero"),
        F.col("skill_assessment_max").cast("int").alias("best"), F.col("last_active_months").alias("months"),
        insufficient_evidence().alias("none"), has_activity().alias("active"),
    )


@query("q44_consistency_audit", f"SELECT doc_id, array_to_string(codes, '|') AS codes, {_units('audit_penalty')} AS penalty, impossible FROM ({_audited_sql()})")
def q44(spark, sf):
    return _audited(spark, sf).select(_id(), F.array_join("codes", "|").alias("codes"), units(F.col("audit_penalty")).alias("penalty"), "impossible")


_ARCHETYPES = (
    ("strong_ai_search_ranking_engineer", "ai_title AND career_retrieval_terms > 0 AND career_production_terms > 0"),
    ("adjacent_backend_data_engineer", "adjacent_title AND career_retrieval_terms > 0"),
    ("product_ml_generalist", "ai_title AND career_production_terms > 0 AND career_retrieval_terms = 0"),
    ("pure_research_candidate", "contains(title_norm, 'research') AND career_production_terms = 0"),
    ("ai_keyword_stuffer", f"({_RISK_RULES[0][1]}) OR ({_RISK_RULES[1][1]})"),
    ("stale_strong_or_stale_profile", "months >= 6 AND rate < 0.2"), ("service_only_candidate", "service_only"),
)


@query("q45_risks_and_archetypes", f"""
SELECT doc_id, array_to_string(risks, '|') AS risks, {_units('risk_penalty')} AS penalty, array_to_string({_named(_ARCHETYPES)}, '|') AS archetypes FROM ({_audited_sql()})""")
def q45(spark, sf):
    rows = features(records(spark, sf)).withColumn("risks", audits.risk_flags())
    return rows.select(
        _id(), F.array_join("risks", "|").alias("risks"), units(sc.risk_penalty(F.col("risks"))).alias("penalty"), F.array_join(profiling.archetypes(), "|").alias("archetypes")
    )


@query("q46_sample_per_archetype", f"""
SELECT label, doc_id FROM (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS n FROM
  (SELECT doc_id, unnest({_named(_ARCHETYPES)}) AS label FROM ({_audited_sql()}))) WHERE n <= 5""")
def q46(spark, sf):
    return profiling.sample_per_label(features(records(spark, sf)), profiling.archetypes(), "candidate_id").select("label", _id())


_FLAG = "(CASE s_{0} WHEN 'true' THEN 1.0::DOUBLE WHEN 'false' THEN 0.0::DOUBLE END)"
_SHARE = "(CASE WHEN s_{0} IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, s_{0}::DOUBLE / {1}::DOUBLE)) END)"
_NOTICE_SQL = "(CASE WHEN notice <= 30 THEN 1.0::DOUBLE WHEN notice <= 60 THEN 0.7::DOUBLE WHEN notice <= 90 THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END)"
_DIMENSIONS = {
    "availability": (_FLAG.format("open_to_work_flag"), _NOTICE_SQL, _FLAG.format("willing_to_relocate"),
                     "(CASE WHEN s_last_active_date IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, "
                     "1.0 - (2026 * 12 + 6 - year(s_last_active_date::DATE) * 12 - month(s_last_active_date::DATE)) / 6.0::DOUBLE)) END)"),
    "engagement": (_SHARE.format("recruiter_response_rate", 1), "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0 - s_avg_response_time_hours::DOUBLE / 240.0::DOUBLE))",
                   _SHARE.format("saved_by_recruiters_30d", 15), _SHARE.format("search_appearance_30d", 150), _SHARE.format("interview_completion_rate", 1)),
    "trust_signal": (_FLAG.format("verified_email"), _FLAG.format("verified_phone"), _FLAG.format("linkedin_connected"), _SHARE.format("profile_completeness_score", 100),
                     _SHARE.format("github_activity_score", 100), _SHARE.format("offer_acceptance_rate", 1), _SHARE.format("endorsements_received", 100)),
}


def _signals_sql(source: str) -> str:
    means = ", ".join(f"round(list_avg(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL)), 4) AS {k}" for k, v in _DIMENSIONS.items())
    return f"SELECT *, {means} FROM ({source})"


@query("q47_dimension_signals", f"""
SELECT doc_id, {', '.join(f"{_units(k, 100)} AS {k.removesuffix('_signal')}" for k in _DIMENSIONS)},
  {_units('round(0.4::DOUBLE * availability + 0.35::DOUBLE * engagement + 0.25::DOUBLE * trust_signal, 4)', 100)} AS hireability,
  {_units('''(round(0.4::DOUBLE * availability + 0.35::DOUBLE * engagement + 0.25::DOUBLE * trust_signal, 4) + CASE WHEN impossible THEN 0.0 ELSE 1.0 - audit_penalty END
    + CASE WHEN github >= 0 THEN 0.5 * github / 100.0 ELSE 0.0 END) / CASE WHEN github >= 0 THEN 2.5 ELSE 2.0 END''', 100)} AS blended
FROM ({_signals_sql(_audited_sql())})""")
def q47(spark, sf):
    """Dimensions from the record's open vocabulary, hireability and the blend of the registered signals."""
    rows = signals.blend(_audited(spark, sf).withColumn("schema_signals", signals.schema_signals()))
    own = (units(F.col(f"schema_signals.{k}"), 100).alias(k) for k in ("availability", "engagement", "trust"))
    return rows.select(_id(), *own, units(F.col("signal_hireability"), 100).alias("hireability"), units(F.col("blended"), 100).alias("blended"))


_RECENT = "(CASE WHEN months <= 1 THEN 1.0::DOUBLE WHEN months <= 3 THEN 0.75::DOUBLE WHEN months <= 6 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END)"
_OPEN = f"(CASE WHEN open IS NULL THEN 0.55::DOUBLE WHEN open THEN 0.55::DOUBLE + 0.45::DOUBLE * {_RECENT} ELSE 0.55::DOUBLE - 0.2::DOUBLE * {_RECENT} END)"
_ACTIVE = "(months < 999 OR rate > 0)"
_REACH = f"(CASE WHEN {_ACTIVE} THEN round({_clamp_sql(f'0.45::DOUBLE * {_RECENT} + 0.35::DOUBLE * rate + 0.2::DOUBLE * {_OPEN}')}, 3) WHEN coalesce(open, false) THEN 0.6 ELSE 0.5 END)"
_BEHAVIORAL = f"""(CASE WHEN NOT {_ACTIVE} AND notice = 0 AND complete = 0 THEN 0.5 ELSE {_clamp_sql(
    f"0.18::DOUBLE * (complete / 100.0::DOUBLE) + 0.2::DOUBLE * {_RECENT} + 0.12::DOUBLE * {_OPEN} + 0.2::DOUBLE * rate + 0.08::DOUBLE * {_clamp_sql('1.0::DOUBLE - hours / 240.0::DOUBLE')}"
    f" + 0.1::DOUBLE * {_NOTICE_SQL} + 0.06::DOUBLE * {_clamp_sql('interviews')} + 0.03::DOUBLE * email::INTEGER + 0.03::DOUBLE * phone::INTEGER")} END)"""


def _tier(c: str, high, a, low, b) -> str:
    return f"(CASE WHEN {c} >= {high} THEN {a}::DOUBLE WHEN {c} >= {low} THEN {b}::DOUBLE ELSE 0.0::DOUBLE END)"


_TRUST = _clamp_sql(
    "(CASE WHEN linked THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END) + " + _tier("github", 40, 0.18, 10, 0.1) + " + " + _tier("saved", 10, 0.18, 4, 0.1) + " + "
    + _tier("appearance", 150, 0.18, 60, 0.1) + " + " + _tier("offers", 0.5, 0.14, 0, 0.06) + " + (CASE WHEN best >= 70 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"
)


def _logistics_sql(spec) -> str:
    city = " OR ".join(f"contains(lower(location), '{c.lower()}')" for c in spec.locations)
    return _clamp_sql(
        f"(CASE WHEN lower(country) = '{spec.country.lower()}' THEN 0.55::DOUBLE ELSE 0.15::DOUBLE END) + (CASE WHEN {city} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END)"
        " + (CASE WHEN relocates THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN s_preferred_work_mode IN ('hybrid', 'flexible') THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)"
    )


def _seniority_sql(spec) -> str:
    (a, b), (c, d) = spec.preferred, spec.strongest
    return (f"(CASE WHEN years BETWEEN {c} AND {d} THEN 1.0::DOUBLE WHEN years BETWEEN {a} AND {b} THEN 0.88::DOUBLE "
            f"WHEN (years >= 4 AND years < {a}) OR (years > {b} AND years <= 11) THEN 0.62::DOUBLE ELSE 0.25::DOUBLE END)")  # fmt: skip


def _give(rule: str, x: float) -> str:
    return f"(CASE WHEN {rule} THEN {x}::DOUBLE ELSE 0.0::DOUBLE END)"


def _capped(c: str, step: float, most: float) -> str:
    return f"least({most}::DOUBLE, {step}::DOUBLE * {c})"


def _quality_sql(spec) -> str:
    own = {k: spec.weights[k] for k in sc.GENERIC}
    return _clamp_sql("(" + " + ".join(f"{w}::DOUBLE * {k}" for k, w in own.items()) + f") / {sum(own.values())!r}::DOUBLE")


def _spine_sql(spec=SPEC, **changes: str) -> str:
    ai = spec.category == scoring.AI_CATEGORY
    covered = {
        "must_cov": ("tokens", spec.must), "nice_cov": ("tokens", spec.nice), "career_must": ("career_tokens", spec.must), "career_nice": ("career_tokens", spec.nice),
        "title_cov": ("title_tokens", (spec.title,)), "disq_cov": ("tokens", spec.disqualifiers),
    }
    columns = ", ".join(f"{_coverage_sql(c, t)} AS {k}" for k, (c, t) in covered.items())
    assessed = "(CASE WHEN best >= 70 THEN 0.08::DOUBLE WHEN best >= 50 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END)"
    grounded, shipped = "career_retrieval_terms > 0", "career_production_terms > 0"
    technical = " + ".join((
        _capped("career_retrieval_terms", 0.07, 0.28), _capped("vector_terms", 0.045, 0.18), _capped("eval_terms", 0.04, 0.16), _capped("career_production_terms", 0.045, 0.18),
        _capped("ml_terms", 0.015, 0.12), "0.12::DOUBLE * must_cov", "0.04::DOUBLE * nice_cov", assessed,
    ) if ai else (
        "0.48::DOUBLE * must_cov", "0.24::DOUBLE * career_must", "0.12::DOUBLE * nice_cov", "0.08::DOUBLE * career_nice", _give(shipped, 0.08), assessed,
    ))
    base = (
        f"(CASE WHEN ai_title THEN 0.32::DOUBLE WHEN adjacent_title THEN 0.18::DOUBLE ELSE 0.0::DOUBLE END) + {_give(grounded, 0.16)} + {_give(shipped, 0.12)}"
        f" - {_give(f'non_tech_title AND NOT ({grounded})', 0.18)} - {_give('service_only AND product_count = 0', 0.12)}"
        if ai else f"0.22::DOUBLE * title_cov + 0.24::DOUBLE * career_must + 0.1::DOUBLE * career_nice + {_give(shipped, 0.1)}"
    )
    named = "contains(lower(industry), 'hr') OR contains(lower(industry), 'ai') OR contains(lower(industry), 'software')"
    career = f"{base} + {_give('product_count > 0', 0.18)} + 0.12::DOUBLE * career_must + 0.04::DOUBLE * career_nice + {_give(named, 0.1)}"
    relevance = _clamp_sql("greatest(career_must, 0.85::DOUBLE * must_cov, 0.5::DOUBLE * title_cov) + 0.1::DOUBLE * nice_cov")
    soft = f"risk_penalty + {_give('disq_cov >= 0.34 AND must_cov < 0.34', 0.06)} + (CASE WHEN impossible THEN 0.0::DOUBLE ELSE audit_penalty END)"
    factors = f"""SELECT *, {_clamp_sql(technical)} AS technical_evidence, {_clamp_sql(career)} AS career_fit, {_seniority_sql(spec)} AS seniority, {_logistics_sql(spec)} AS logistics,
      {_BEHAVIORAL} AS behavioral, {_TRUST} AS trust, {relevance} AS raw_relevance, {soft} AS soft, list_distinct(list_concat(risks, codes)) AS flags, {_REACH} AS reach
      FROM (SELECT *, {columns} FROM ({_audited_sql(**changes)}))"""
    parts = f"0.6::DOUBLE * raw_relevance + 0.25::DOUBLE * career_must + {_give(shipped, 0.1)}"
    return _finish_sql(factors, spec, "impossible", parts)


def _finish_sql(factors: str, spec, veto: str, parts: str) -> str:
    base = _clamp_sql("pow(role_relevance, 1.1::DOUBLE) * (0.45::DOUBLE + 0.55::DOUBLE * general_quality)")
    return f"""SELECT *, CASE WHEN {veto} THEN 0.0::DOUBLE ELSE round({base} * {_clamp_sql('1.0::DOUBLE - soft', '0.6')}, 6) END AS final_score,
      NOT ({veto}) AND role_relevance >= 0.34 AND NOT none AS top10_eligible, CASE WHEN {veto} THEN 1.0::DOUBLE ELSE soft END AS penalty,
      CASE WHEN none THEN 0.0::DOUBLE ELSE {_clamp_sql(f"{parts} + 0.05::DOUBLE * (len(flags) = 0 AND NOT none)::INTEGER")} END AS confidence
      FROM (SELECT *, CASE WHEN none THEN 0.0::DOUBLE ELSE raw_relevance END AS role_relevance, {_quality_sql(spec)} AS general_quality FROM ({factors}))"""


_SCORES = (*lx.FACTORS, "role_relevance", "general_quality", "final_score", "penalty", "confidence")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(_id(), *(units(F.col(c)).alias(c) for c in _SCORES), "top10_eligible")


@query("q48_spine_scores", f"SELECT doc_id, {', '.join(f'{_units(f"round({c}, 6)")} AS {c}' for c in _SCORES)}, top10_eligible FROM ({_spine_sql()})")
def q48(spark, sf):
    """Every factor of the lexical path, gate, veto, penalty, confidence and eligibility."""
    return _shown(_spine(records(spark, sf)))


@query("q49_spine_scores_other_category", f"SELECT doc_id, {', '.join(f'{_units(f"round({c}, 6)")} AS {c}' for c in _SCORES)}, top10_eligible FROM ({_spine_sql(OTHER)})")
def q49(spark, sf):
    return _shown(scoring.score_lexical(_audited(spark, sf), OTHER))


def _head_sql(spec, n: int) -> str:
    return f"""SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY round(final_score, 3) DESC, reach DESC, doc_id)::INTEGER AS rank FROM ({_spine_sql(spec)})) WHERE rank <= {n}"""


@query("q50_rank_many", f"SELECT 'search' AS job_id, doc_id, rank FROM ({_head_sql(SPEC, 40)}) UNION ALL SELECT 'backend', doc_id, rank FROM ({_head_sql(OTHER, 40)})")
def q50(spark, sf):
    """Heads of two jobs by score, reachability and id, from one scan."""
    return engine.rank_many(spark, {"search": SPEC, "backend": OTHER}, records(spark, sf), top_n=40).select("job_id", _id(), "rank")


# Reasons of the head and their audit.

def _variant_sql(options) -> str:
    seed = "list_sum(list_transform(regexp_extract_all(lpad(doc_id::VARCHAR, 12, '0'), '.'), lambda c: ascii(c))) + rank"
    return f"{_list(options)}[(({seed}) % {len(options)})::INTEGER + 1]"


_SEEN = "(months <= 3 OR rate >= 0.4)"
_REACH_LABEL = (
    f"(CASE WHEN NOT {_ACTIVE} AND coalesce(open, false) THEN 'reachable' WHEN NOT {_ACTIVE} THEN 'unknown' WHEN {_SEEN} AND NOT coalesce(open, true) THEN 'passive' "
    f"WHEN {_SEEN} THEN 'reachable' WHEN months >= 6 OR rate < 0.15 THEN 'stale' ELSE 'passive' END)"
)
_MUST_WORDS = [w for t in SPEC.must for w in tx.keywords_of(t)]
_TERMS_SQL = (
    f"list_concat(list_filter({_list(_MUST_WORDS)}, lambda w: list_contains(tokens, w)), "
    f"list_filter({_list(sorted(lx.RETRIEVAL_TERMS))}, lambda t: contains(career_text, t) AND list_contains(tokens, t)))"
)
_LEADS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN round({k}, 6) - round(lead({k}) OVER (ORDER BY rank), 6) >= {explain.CLEAR_LEAD}::DOUBLE THEN '{v.lower()}' END" for k, v in explain.FACTOR_LABELS.items()
) + "], lambda x: x IS NOT NULL)[1]"
#: The first of equal elements stays, in order.
_DISTINCT_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


def _reasons_sql(n: int) -> str:
    """The head of the lexical path with its reasons."""
    head = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(final_score, 3) DESC, reach DESC, doc_id)::INTEGER AS rank FROM ({_spine_sql()})) WHERE rank <= {n}"""
    parts = f"""SELECT *, CASE WHEN rank <= 5 THEN 'top' WHEN rank <= 20 THEN 'high' WHEN rank <= 60 THEN 'mid' ELSE 'low' END AS band, {_TERMS_SQL} AS named,
      {_LEADS_SQL} AS led, {_REACH_LABEL} AS label, CASE WHEN none THEN list_append(flags, 'insufficient_evidence') ELSE flags END AS all_flags FROM ({head})"""
    opener = "CASE band " + " ".join(f"WHEN '{k}' THEN {_variant_sql(v)}" for k, v in explain.OPENERS.items()) + " END"
    strength = f"""(CASE WHEN trim(title) <> '' THEN title || ', ' ELSE '' END) || printf('%.1f years', years) ||
      (CASE WHEN round(role_relevance, 6) >= 0.7 THEN '; covers most of what the role asks for: ' WHEN round(role_relevance, 6) >= 0.45 THEN '; covers much of the role: '
        WHEN round(role_relevance, 6) >= 0.25 THEN '; covers some of the role: ' ELSE '; covers little of the role: ' END) ||
      coalesce(nullif(array_to_string({_DISTINCT_SQL.format('named')}[1:4], ', '), ''), 'related work') || '.'"""
    reach = """CASE WHEN band IN ('top', 'high') THEN CASE label WHEN 'reachable' THEN 'Likely to answer.' WHEN 'stale' THEN 'Has been inactive for long.'
      WHEN 'passive' THEN 'Not looking, but active.' END END"""
    caution = """CASE WHEN len(all_flags) > 0 THEN 'To check: ' || replace(array_to_string(flags_in_order[1:2], '; '), '_', ' ') || '.'
      WHEN band = 'low' THEN 'Check the main requirements before a call.' END"""
    ordered = _DISTINCT_SQL.format("list_concat(risks, codes)")
    return f"""SELECT *, CASE WHEN none THEN 'The record has too little usable data to assess; check its format.' ELSE left(concat_ws(' ', {opener}, {strength},
      CASE WHEN rank <= 25 AND led IS NOT NULL THEN 'Ahead of #' || (rank + 1) || ' on ' || led || '.' END, {reach}, {caution}), 500) END AS reasoning
      FROM (SELECT *, {ordered} AS flags_in_order FROM ({parts}))"""


@query("q57_reasons", f"SELECT doc_id, rank, reasoning FROM ({_reasons_sql(100)})")
def q57(spark, sf):
    """The head of 100 with its reasons, as the ranking facade gives them."""
    return engine.rank(spark, SPEC, records(spark, sf), engine="spine").head.select(_id(), F.col("rank").cast("int").alias("rank"), "reasoning")


_GROUNDS = {
    "career_retrieval_terms": ("career_text", lx.RETRIEVAL_TERMS), "career_production_terms": ("career_text", lx.PRODUCTION_TERMS),
    "skill_retrieval_terms": ("skill_text", lx.RETRIEVAL_TERMS), "skill_vector_terms": ("skill_text", lx.VECTOR_TERMS), "skill_ml_terms": ("skill_text", lx.ML_TERMS),
    "vector_terms": ("all_text", lx.VECTOR_TERMS), "eval_terms": ("all_text", lx.EVAL_TERMS), "production_terms": ("all_text", lx.PRODUCTION_TERMS),
}
_EVIDENCE_SQL = (
    "list_concat(regexp_extract_all(lower(all_text || ' ' || career_text || ' ' || skill_text || ' ' || title), '[a-z0-9+#./]+'), [lower(title), lower(location), lower(country)]"
    + "".join(f", list_filter({_list(sorted(terms))}, lambda t: contains({c}, t))" for c, terms in _GROUNDS.values()) + ")"
)
_CLAIMS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(trim(reasoning)), '\\b{t}\\b') AND NOT list_contains(evidence, '{t}') THEN '{t}' END" for t in validation.CHECKED_TERMS
) + "], lambda x: x IS NOT NULL)"
_PROBLEMS_SQL = f"""list_filter([CASE WHEN count(*) OVER (PARTITION BY whose, trim(reasoning)) > 1 THEN 'duplicate' END, CASE WHEN trim(reasoning) = '' THEN 'empty' END,
  CASE WHEN length(trim(reasoning)) < 40 THEN 'short' END, CASE WHEN length(trim(reasoning)) > 500 THEN 'long' END,
  CASE WHEN rank > 75 AND contains(lower(reasoning), 'excellent') THEN 'overstated' END,
  CASE WHEN len({_CLAIMS_SQL}) > 0 THEN 'not_in_record: ' || array_to_string({_CLAIMS_SQL}, ', ') END], lambda x: x IS NOT NULL)"""


@query("q58_grounding_audit", f"""WITH head AS (SELECT *, {_EVIDENCE_SQL} AS evidence FROM ({_reasons_sql(100)})),
  told AS (SELECT 'own' AS whose, doc_id, rank, reasoning, evidence FROM head UNION ALL
    SELECT 'next', doc_id, rank, coalesce(lead(reasoning) OVER (ORDER BY rank), ''), evidence FROM head)
SELECT whose, doc_id, unnest({_PROBLEMS_SQL}) AS problem FROM told""")
def q58(spark, sf):
    """The audit of the head's reasons, and of the same head with each reason moved up by one row, which must be found out."""
    head = validation.evidence_tokens(engine.rank(spark, SPEC, records(spark, sf), engine="spine").head)
    moved = ranking.with_neighbour(head.drop("neighbour"), ["reasoning"]).withColumn("reasoning", F.col("neighbour.reasoning"))
    found = [validation.reason_problems(rows, "evidence").select(F.lit(whose).alias("whose"), _id(), "problem") for whose, rows in (("own", head), ("next", moved))]
    return found[0].unionByName(found[1])


# The hybrid path.

def _vector_list(v) -> str:
    return "[" + ", ".join(map(str, v)) + "]::DOUBLE[]"


def _hybrid_sql(spec=SPEC) -> str:
    """Matches as lists of scores and lexical shares in the order of requirements, and the path's factors."""
    dense = ", ".join(
        f"CASE WHEN e IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (list_cosine_similarity(e, {_vector_list(v)}) - 0.12::DOUBLE) / (0.65::DOUBLE - 0.12::DOUBLE))) END"
        for v in EMBEDDED)
    lexical = ", ".join(
        f"len(list_filter({_list(r.keywords)}, lambda k: list_contains(match_tokens, k))) / {len(r.keywords)}.0::DOUBLE" if r.keywords else "0.0::DOUBLE" for r in spec.requirements)
    weight = [r.weight for r in spec.requirements]
    places = {k: [i + 1 for i, r in enumerate(spec.requirements) if r.kind == k] for k in (lx.MUST, lx.NICE, lx.DISQUALIFIER)}
    mean = lambda c, own: "(" + " + ".join(f"{weight[i - 1]}::DOUBLE * {c}[{i}]" for i in own) + f") / {sum(weight[i - 1] for i in own)!r}::DOUBLE"
    covered = " + ".join(f"(sc[{i}] >= 0.3)::INTEGER" for i in places[lx.MUST])
    worst = "greatest(" + ", ".join(f"sc[{i}]" for i in places[lx.DISQUALIFIER]) + ", 0.0)"
    matched = f"""SELECT *, list_transform(lex, lambda x, i: CASE WHEN den[i] IS NULL THEN x ELSE 0.6::DOUBLE * den[i] + 0.4::DOUBLE * x END) AS sc FROM
      (SELECT r.*, [{lexical}] AS lex, [{dense}] AS den FROM ({_signals_sql(_audited_sql())}) r LEFT JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) ON vec_id = doc_id)"""
    fit = f"""SELECT *, round(least(1.0::DOUBLE, 0.85::DOUBLE * {mean('sc', places[lx.MUST])} + 0.15::DOUBLE * {mean('sc', places[lx.NICE])}), 4) AS semantic_fit,
      round({mean('lex', range(1, len(weight) + 1))}, 4) AS lexical_fit, round(({covered}) / {len(places[lx.MUST])}.0::DOUBLE, 4) AS coverage, round({worst}, 4) AS disqualifier,
      {_coverage_sql('career_tokens', spec.must)} AS career_lexical FROM ({matched})"""
    hit = "disqualifier >= 0.5"
    factors = f"""SELECT *, {_clamp_sql('0.8::DOUBLE * semantic_fit + 0.2::DOUBLE * lexical_fit')} AS technical_evidence,
      {_clamp_sql(f"0.55::DOUBLE * coverage + 0.2::DOUBLE * career_lexical + 0.15::DOUBLE * semantic_fit + {_give('product_count > 0', 0.1)}")} AS career_fit,
      {_seniority_sql(spec)} AS seniority, {_logistics_sql(spec)} AS logistics, {_clamp_sql(f"0.34::DOUBLE * availability + 0.33::DOUBLE * engagement + 0.33::DOUBLE * {_BEHAVIORAL}")} AS behavioral,
      {_clamp_sql(f"0.5::DOUBLE * {_TRUST} + 0.5::DOUBLE * trust_signal")} AS trust,
      {_clamp_sql('0.55::DOUBLE * semantic_fit + 0.3::DOUBLE * coverage + 0.15::DOUBLE * career_lexical')} AS raw_relevance,
      audit_penalty + {_give(f'{hit} AND coverage >= 0.5', 0.2)} AS soft, impossible OR ({hit} AND coverage < 0.5) AS vetoed,
      CASE WHEN {hit} THEN list_append(codes, 'semantic_disqualifier_overlap') ELSE codes END AS flags, {_REACH} AS reach FROM ({fit})"""
    parts = f"0.5::DOUBLE * raw_relevance + 0.2::DOUBLE * coverage + {_give('career_lexical >= 0.34', 0.15)} + 0.1::DOUBLE * engagement"
    return _finish_sql(factors, spec, "vetoed", parts)


def _hybrid(spark, sf) -> DataFrame:
    index = read(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("candidate_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return engine.score_pool(records(spark, sf), SPEC, "hybrid", index=index, embedded=EMBEDDED)


_FIT = ("semantic_fit", "lexical_fit", "coverage", "disqualifier")


@query("q51_hybrid_scores", f"""SELECT doc_id, {', '.join(f'{_units(f"round({c}, 6)", 1000)} AS {c}' for c in (*_SCORES, *_FIT))}, top10_eligible,
  array_to_string(flags, '|') AS flags FROM ({_hybrid_sql()})""")
def q51(spark, sf):
    """Requirements against words and vectors, their summary and every factor of the hybrid path; no candidate is dropped."""
    rows = _hybrid(spark, sf)
    fit = (units(F.col(f"fit.{c}"), 1000).alias(c) for c in _FIT)
    return rows.select(_id(), *(units(F.col(c), 1000).alias(c) for c in _SCORES), *fit, "top10_eligible", F.array_join("risk_flags", "|").alias("flags"))


@query("q52_top_matches", f"""SELECT doc_id, array_to_string(list_transform(list_sort(list_filter(list_transform(sc, lambda x, i: {{'s': -x, 'i': i - 1}}),
  lambda x: -x.s >= 0.3 AND x.i < {len(SPEC.requirements) - len(SPEC.disqualifiers)}))[1:4], lambda x: x.i::VARCHAR), '|') AS best FROM ({_hybrid_sql()})""")
def q52(spark, sf):
    best = F.transform(matching.top_matches(), lambda m: m["req_idx"].cast("string"))
    return _hybrid(spark, sf).select(_id(), F.array_join(best, "|").alias("best"))


# Attacks and invariance.

_STUFFED = " ".join((*SPEC.must, *SPEC.nice))
_ATTACKS = {
    "keyword_stuffing": {"summary": f"coalesce(text, '') || ' {_STUFFED}'"}, "skill_stuffing": {"more_skills": _list(SPEC.must)},
    "fabricated_experience": {"months1": f"{MONTHS[0]} + 120", "months2": f"{MONTHS[1]} + 120"},
    "title_inflation": {"title": f"'{SPEC.title}'", "headline": f"'{SPEC.title}'"},
}
_PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS attack, a.doc_id, b.final_score - a.final_score AS gain, len(list_filter(b.flags, lambda f: NOT list_contains(a.flags, f))) > 0 AS flagged
    FROM before a JOIN ({_spine_sql(**changes)}) b ON a.doc_id = b.doc_id""" for name, changes in _ATTACKS.items())


@query("q53_attack_resistance", f"""WITH before AS ({_spine_sql()}), p AS ({_PAIRS_SQL})
SELECT attack, count(*) AS n, {_units('avg((flagged OR gain <= 0.02)::INTEGER)', 1000)} AS resistance, {_units('avg(gain)', 1000)} AS mean_gain FROM p GROUP BY GROUPING SETS ((attack), ())""")
def q53(spark, sf):
    """All four attacks on every record, by attack and over all."""
    rates = adversarial.resistance(records(spark, sf), SPEC, _spine)
    return rates.select("attack", "n", units(F.col("resistance"), 1000).alias("resistance"), units(F.col("mean_gain"), 1000).alias("mean_gain"))


@query("q54_location_effect", f"""SELECT a.doc_id, {_units('abs(a.logistics - b.logistics)', 1000)} AS spread FROM
  ({_spine_sql(location="'Pune'", country="'India'")}) a JOIN ({_spine_sql(location="'Oslo'", country="'Norway'")}) b ON a.doc_id = b.doc_id""")
def q54(spark, sf):
    spread = adversarial.location_effect(records(spark, sf), [("Pune", "India"), ("Oslo", "Norway")], _spine)
    return spread.select(_id(), units(F.col("spread"), 1000).alias("spread"))


@query("q55_name_invariance", "WITH before AS (" + _spine_sql() + ") " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, {_units('max(abs(a.final_score - b.final_score))', 1000)} AS largest FROM before a JOIN ("
    + _spine_sql(headline=f"'{name} ' || ({PLAIN['headline']})", summary=f"'{name} ' || coalesce(text, '')") + ") b ON a.doc_id = b.doc_id" for name in adversarial.NAMES))
def q55(spark, sf):
    """Names put into headline and summary must not move a score."""
    return adversarial.name_changes(records(spark, sf), _spine).select("name", units(F.col("largest"), 1000).alias("largest"))


@query("q56_reachability", f"SELECT doc_id, {_units(_REACH, 1000)} AS reach FROM ({_features_sql()})")
def q56(spark, sf):
    reach = sc.reachability(F.col("last_active_months"), F.col("response_rate"), F.col("open_to_work"))
    return features(records(spark, sf)).select(_id(), units(reach["score"], 1000).alias("reach"))


# Repair of lines that hold records, whole or damaged.

_QUOTED = "coalesce(text, '')"
for _raw, _escaped in ((92, "chr(92) || chr(92)"), (34, "chr(92) || chr(34)"), (10, "chr(92) || 'n'"), (13, "chr(92) || 'r'"), (9, "chr(92) || 't'")):
    _QUOTED = f"replace({_QUOTED}, chr({_raw}), {_escaped})"
_SUMMARY = f"'\"summary\":\"' || {_QUOTED} || '\"'"


def _piece(of: int, *values: str) -> str:
    """One of the SQL texts by doc_id; the last for the rest."""
    return f"CASE doc_id % {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_RECORD = "'{' || " + " || ',' || ".join(f"({p})" for p in (
    _piece(7, "'\"other\":1'", "'\"candidate_id\":null'", "'\"candidate_id\":\"D' || CAST(doc_id AS STRING) || '\"'"),
    _piece(5, "'\"profile\":3'", f"'\"profile\":{{' || {_SUMMARY} || '}}'", f"'\"profile\":{{' || {_SUMMARY} || ',\"location\":\"Pune\",\"current_title\":\"Cook\",\"years_of_experience\":4.5}}'",
           f"'\"profile\":{{\"years_of_experience\":0,\"current_title\":\"\",' || {_SUMMARY} || '}}'", "'\"profile\":{\"years_of_experience\":\"7\",\"current_company\":\"Own\"}'"),
    _piece(4, "'\"career_history\":null'", "'\"career_history\":[{\"title\":\"A\",\"company\":\"X\",\"duration_months\":' || CAST(doc_id % 90 AS STRING) || '},\"x\",{\"title\":\"B\",\"is_current\":true,\"duration_months\":\"15\"}]'",
           "'\"career_history\":[{\"title\":\"C\",\"company\":\"Z\",\"duration_months\":2.7},{\"company\":\"W\",\"duration_months\":null}]'", "'\"career_history\":{}'"),
    _piece(3, "'\"skills\":null'", "'\"skills\":[\"Python\",{\"name\":\"SQL\"}]'", "'\"skills\":\"x\"'"),
    _piece(6, "'\"signals\":{\"verified_email\":true}'", "'\"signals\":{\"profile_completeness_score\":77}'", "'\"signals\":5'", "'\"signals\":null'", "'\"education\":[]'"),
)) + " || '}'"
LINE = _piece(13, f"left({_RECORD}, length({_RECORD}) - 1)", f"'[' || {_RECORD} || ']'", "'  '", "'not json: ' || coalesce(text, '')", _RECORD)

_JOBS_SQL = """CASE WHEN json_type(r, '$.career_history') = 'ARRAY' THEN list_filter(CAST(r->'$.career_history' AS JSON[]), lambda x: json_type(x) = 'OBJECT') ELSE [] END"""
_NONE = "coalesce({0}, '') = ''"


@query("q59_repair", f"""WITH lines AS (SELECT doc_id, {LINE} AS line FROM documents),
  j AS (SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'not_json' WHEN json_type(line) <> 'OBJECT' THEN 'not_object' END AS error,
    CASE WHEN json_valid(line) AND json_type(line) = 'OBJECT' THEN line ELSE '{{}}' END::JSON AS r FROM lines),
  a AS (SELECT *, {_JOBS_SQL} AS jobs, json_type(r, '$.profile') = 'OBJECT' AS has_profile, json_array_length(r, '$.career_history') AS n_items,
    CASE WHEN json_type(r, '$.skills') = 'ARRAY' THEN json_array_length(r, '$.skills') ELSE 0 END AS n_skills FROM j),
  b AS (SELECT *, coalesce(list_sum(list_transform(jobs, lambda x: floor(coalesce(try_cast(x->>'$.duration_months' AS DOUBLE), 0)))), 0)::BIGINT AS months,
    coalesce(list_filter(jobs, lambda x: x->>'$.is_current' = 'true')[1], jobs[1]) AS now, r->>'$.profile.current_title' AS given_title,
    try_cast(r->>'$.profile.years_of_experience' AS DOUBLE) AS given_years, r->>'$.profile.current_company' AS given_company FROM a),
  c AS (SELECT *, coalesce(given_years, 0) = 0 AND months <> 0 AS no_years, {_NONE.format('given_title')} AND now IS NOT NULL AS no_title FROM b),
  d AS (SELECT *, no_title AND {_NONE.format('given_company')} AS no_company, CASE WHEN no_title THEN coalesce(now->>'$.title', '') ELSE given_title END AS title FROM c),
  e AS (SELECT *, list_filter([CASE WHEN NOT coalesce(has_profile, false) THEN 'profile' END, CASE WHEN coalesce(json_type(r, '$.career_history'), '') <> 'ARRAY' THEN 'career_history' END,
    CASE WHEN coalesce(json_type(r, '$.education'), '') <> 'ARRAY' THEN 'education' END, CASE WHEN coalesce(json_type(r, '$.skills'), '') <> 'ARRAY' THEN 'skills' END,
    CASE WHEN coalesce(json_type(r, '$.signals'), '') <> 'OBJECT' THEN 'signals' END, CASE WHEN {_NONE.format("r->>'$.candidate_id'")} THEN 'id' END,
    CASE WHEN len(jobs) < n_items THEN 'jobs' END, CASE WHEN no_years THEN 'years' END, CASE WHEN no_title THEN 'title' END, CASE WHEN no_company THEN 'company' END,
    CASE WHEN (r->>'$.signals.profile_completeness_score') IS NULL THEN 'completeness' END, CASE WHEN (r->>'$.signals.verified_email') IS NULL THEN 'verified' END], lambda x: x IS NOT NULL) AS fixed,
    coalesce((r->>'$.signals.profile_completeness_score')::BIGINT, 20 + 16 * ((NOT {_NONE.format("r->>'$.profile.summary'")})::INTEGER + (NOT {_NONE.format('title')})::INTEGER
      + (NOT {_NONE.format("r->>'$.profile.location'")})::INTEGER + (len(jobs) > 0)::INTEGER + (n_skills > 0)::INTEGER))::BIGINT AS complete FROM d)
SELECT doc_id, error, CASE WHEN error IS NULL THEN array_to_string(fixed, '|') ELSE '' END AS fixes, CASE WHEN error IS NULL THEN r->>'$.candidate_id' END AS given_id,
  CASE WHEN error IS NULL THEN sha256(coalesce(r->>'$.profile.summary', '')) END AS summary_sha256,
  CASE WHEN error IS NULL THEN CASE WHEN no_years THEN (months * 10 // 12 + CASE WHEN months * 10 % 12 > 6 OR (months * 10 % 12 = 6 AND months * 10 // 12 % 2 = 1) THEN 1 ELSE 0 END)::BIGINT
    ELSE round(given_years * 10)::BIGINT END END AS years_tenths,
  CASE WHEN error IS NULL THEN title END AS title, CASE WHEN error IS NULL THEN CASE WHEN no_company THEN coalesce(now->>'$.company', '') ELSE given_company END END AS company,
  CASE WHEN error IS NULL THEN complete END AS complete, CASE WHEN error IS NULL THEN coalesce(r->>'$.signals.verified_email', 'false') END AS verified,
  CASE WHEN error IS NULL THEN len(jobs)::INTEGER END AS n_jobs, CASE WHEN error IS NULL THEN n_skills::INTEGER END AS n_skills FROM e""")
def q59(spark, sf):
    """Every line gives a row: what was repaired and to what, or why it was turned away."""
    lines = read(spark, sf, "documents").select("doc_id", F.expr(LINE).alias("line"))
    rows = repair.repaired(lines, "line", position="doc_id", keep=("doc_id",))
    fine = F.col("error").isNull()
    given = F.when(fine & ~F.array_contains("fixes", "id"), F.col("candidate_id"))
    return rows.select(
        "doc_id", F.col("error.kind").alias("error"), F.array_join("fixes", "|").alias("fixes"), given.alias("given_id"),
        F.when(fine, F.sha2(F.coalesce("profile.summary", F.lit("")), 256)).alias("summary_sha256"),
        F.round(F.col("profile.years_of_experience") * 10).cast("long").alias("years_tenths"), F.col("profile.current_title").alias("title"),
        F.col("profile.current_company").alias("company"), F.col("signals.profile_completeness_score").cast("long").alias("complete"),
        F.col("signals.verified_email").alias("verified"), F.when(fine, F.size("career_history")).alias("n_jobs"), F.when(fine, F.size("skills")).alias("n_skills"),
    )


# Job descriptions, one for each document: the whole text among sections of requirements.

_NL = " || chr(10) || "
DESCRIPTION = _NL.join((
    _pick("Senior Search Engineer.", "We hire", "Accountant, Pune", "Data Engineer (Remote).", ""),
    _pick("5-9 years.", "Pune or Noida", "6+ years of experience in retrieval, ranking and search", "About the role:", "3 to 5 yrs, Berlin", "Must have 4-8 years, Mumbai, ideally more"),
    "coalesce(text, '')",
    _pick("Must have strong Python, SQL and Spark.", "You need:", "Requirements: retrieval/ranking, vector search or embeddings", "Experience with Kafka; monitoring; and on-call work.", "", "We need people who ship. Deep knowledge of NDCG, recall and offline tests is critical."),
    _pick("Nice to have:", "Bonus points for LoRA, distillation, and quantisation work.", "Things you would like", ""),
    _pick("Terraform and Helm", "open source work on search engines, or papers; talks/blogs", "Python, SQL and Spark.", "a, b, c", "go, r and c++ in .NET shops"),
    _pick("Not a fit: pure research careers.", "We will not move forward with keyword lists.", "", "Red flag: job hopping every year, or no shipped work.", "We do not want consultants"),
    _pick("Relocation to Pune is possible.", "10+ years", "python and sql.", "Must have Python, SQL and Spark."),
))


def _has(c: str, cues) -> str:
    return f"len(list_filter({_list(cues)}, lambda x: contains({c}, x))) > 0"


def _matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


_CUT_SQL = "regexp_replace(description, '([.!?;:])\\s+', '\\1' || chr(1), 'g')"
# white space behind line ends is a second cut
_CUT_SQL = f"regexp_replace(regexp_replace({_CUT_SQL}, '\\n+[ \\t\\f\\r]\\s*', chr(1) || chr(1), 'g'), '\\n+', chr(1), 'g')"
_CITY_SQL = f"(?i)\\b({'|'.join(lx.CITIES)})\\b"
_REST_SQL = f"regexp_replace(regexp_replace(regexp_replace(low, '{tx.YEARS_BAND}', '', 'g'), '{tx.YEARS_FROM}', '', 'g'), '{_CITY_SQL}', '', 'g')"
_BARE_SQL = f"rtrim(regexp_replace(trim(regexp_replace(s, '{requirements.LEAD_CUE}', '')), '\\.+$', ''))"
_ITEMS_SQL = f"list_transform(string_split_regex({_BARE_SQL}, '{requirements.LIST_SEPARATOR}'), lambda p: regexp_replace(p, '^[ .,:]+|[ .,:]+$', '', 'g'))"


@query("q60_job_descriptions", f"""WITH pieces AS (SELECT doc_id, string_split({_CUT_SQL}, chr(1)) AS p FROM (SELECT doc_id, {DESCRIPTION} AS description FROM documents)),
  told AS (SELECT doc_id, pos, s, lower(s) AS low, len(string_split(s, ' ')) AS words, len(list_distinct({_telling_sql('s')})) AS n_keywords FROM
    (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, trim(regexp_replace(unnest(p), '\\s+', ' ', 'g')) AS s FROM pieces) WHERE s <> ''),
  kinds AS (SELECT *, coalesce(last_value(cue IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '{lx.MUST}') AS kind,
    {_matches('low', tx.YEARS_BAND)} OR {_matches('low', tx.YEARS_FROM)} AS years, {_matches('s', _CITY_SQL)} AS placed, {_has('low', lx.EMPHASIS_CUES)} AS stressed,
    len(list_filter(regexp_extract_all({_REST_SQL}, '[a-z]{{3,}}'), lambda t: NOT list_contains({_list([*lx.STOPWORDS, *requirements.NOT_SUBSTANCE])}, t))) AS rest FROM
    (SELECT *, CASE WHEN {_has('low', lx.DISQUALIFIER_CUES)} THEN '{lx.DISQUALIFIER}' WHEN {_has('low', lx.NICE_CUES)} THEN '{lx.NICE}' WHEN {_has('low', lx.MUST_CUES)} THEN '{lx.MUST}' END AS cue FROM told)),
  kept AS (SELECT *, {_ITEMS_SQL} AS raw_items FROM kinds WHERE n_keywords >= 2 AND NOT (words <= 6 AND s LIKE '%:')
    AND NOT ((years OR placed) AND ((rest <= 2 AND words <= 12) OR (years AND NOT {_has('low', lx.DISQUALIFIER_CUES)} AND {_matches('s', '^\\s*[0-9]')})))
    AND NOT (pos < 4 AND words <= 12 AND NOT {_matches('s', requirements.REQUIREMENT_VERB)} AND NOT (contains(s, ',') AND words >= 4) AND (words <= 6 OR {_matches('s', requirements.ROLE_WORD)}))),
  items AS (SELECT *, list_filter(raw_items, lambda p: length(p) >= 2 AND len({_telling_sql('p')}) >= 1) AS own FROM kept),
  parts AS (SELECT doc_id, pos, kind, stressed, unnest(generate_series(0, len(texts) - 1)) AS item, unnest(texts) AS text FROM (SELECT *,
    CASE WHEN len(own) >= 2 AND len(list_filter(own, lambda p: len(string_split_regex(trim(p), '\\s+')) > 5)) = 0 THEN own ELSE [s] END AS texts FROM items)),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, left(lower(text), 80) ORDER BY pos, item) AS n FROM parts),
  named AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(told), lambda t: {{'i': list_position(told, t), 't': t}}))[1:6], lambda x: x.t) AS keywords
    FROM (SELECT *, {_telling_sql('text')} AS told FROM firsts WHERE n = 1))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, item) - 1)::INTEGER AS req_idx, text, kind,
  CASE WHEN kind = '{lx.NICE}' THEN 40 WHEN kind = '{lx.MUST}' AND stressed THEN 125 ELSE 100 END::INTEGER AS weight_percent, array_to_string(keywords, '|') AS keywords
FROM named WHERE len(keywords) >= 1""")
def q60(spark, sf):
    """Descriptions to weighted requirements: sections, list items, emphasis, what is left out, the first of equals."""
    jobs = read(spark, sf, "documents").select("doc_id", F.expr(DESCRIPTION).alias("description"))
    return requirements.parse_table(jobs, "doc_id", "description").select(
        F.col("job_id").alias("doc_id"), "req_idx", "text", "kind", F.round(F.col("weight") * 100).cast("int").alias("weight_percent"), F.array_join("keywords", "|").alias("keywords"),
    )


# Resumes, one for each document: the whole text among headings, jobs, schools and skills.

RESUME = _NL.join((
    _pick("Asha Rao", "SUMMARY", "Lead Analyst, Delta, 2009 to 2011", "", "x.y@host.io"),
    _pick("Pune, India", "9 years in search", "Work History:", "  Experience", "Berlin"),
    _pick("Senior Engineer at Acme (2019 - present)", "Data Engineer", "LEAD ARCHITECT | OMEGA | 2018-PRESENT", "2018 - 2022", "- built things", "Head of sales and of everything else that there was to do, Beta"),
    _pick("Gamma Labs", "2016 - 2018", "Analyst", "one two three four five", "- shipped", "Manager (2001 to 2004)", "Employment"),
    _pick("2014 - 2016", "Beta Corp", "", "Intern @ Zeta", "x"),
    "coalesce(text, '')",
    _pick("Education", "Director, Kappa, 2011 - current", "skills:", "Consultant"),
    _pick("B.Tech, Some Institute 2016", "Omega", "1999 - 2001", "about", "  Staff Scientist at Iota  "),
    _pick("Technical Skills", "Career", "1997 - 1999", ""),
    _pick("Python, SQL; Kafka", "Engineer", "Theta"),
))


def _whole_word_sql(c: str, choice: str) -> str:
    """A caseless word between what is no letter, digit or line, as other engines' word ends know ASCII alone."""
    return _matches(c, f"(?i)(^|[^\\p{{L}}\\p{{N}}_]){choice}($|[^\\p{{L}}\\p{{N}}_])")


_TITLES = "(engineer|developer|analyst|manager|lead|architect|scientist|consultant|designer|director|head|specialist|administrator|sde|intern|principal|staff|senior|advisory|associate)"
_SPAN = "(?i)\\b((?:19|20)\\d{2})\\b\\s*[-–to]+\\s*((?:19|20)\\d{2}\\b|present|current)"
_HEADS = {
    "experience": "work\\s+experience|work\\s+history|experience|employment|professional\\s+experience|career", "education": "education|academic",
    "skills": "technical\\s+skills|core\\s+competencies|technologies|skills", "summary": "summary|profile|objective|about",
}
_HEADING_SQL = "CASE WHEN words > 3 THEN NULL " + " ".join(f"WHEN regexp_full_match(trim(rtrim(lower(s), ':')), '{p}') THEN '{n}'" for n, p in _HEADS.items()) + " END"
_JOB = "(b.(?:.n(?:.w)?|.w(?:.n)?|...[nw])?|c.(?:.n|...n)?|s.(?:.w|...w)?|f.)((?:-.)*)"


def _parts_sql(line: str, span: str) -> str:
    bare = f"trim(regexp_replace(CASE WHEN {span} <> '' THEN replace({line}, {span}, ' ') ELSE {line} END, '[()]', ' ', 'g'), ' ,-|')"
    return f"list_filter(list_transform(string_split_regex({bare}, '\\s*[|@]\\s*|\\s+at\\s+|\\s*,\\s*'), lambda p: trim(p)), lambda p: p <> '')"


@query("q61_resumes", f"""WITH texts AS (SELECT doc_id, string_split({RESUME}, chr(10)) AS p FROM documents),
  lines AS (SELECT doc_id, pos, s, CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '\\s+')) END AS words, regexp_extract(s, '{_SPAN}') AS span, {_whole_word_sql('s', _TITLES)} AS titled FROM
    (SELECT doc_id, unnest(generate_series(1, len(p))) AS pos, regexp_replace(unnest(p), '^\\s+|\\s+$', '', 'g') AS s FROM texts)),
  headed AS (SELECT *, {_HEADING_SQL} AS heading, {_parts_sql('s', 'span')} AS parts FROM lines),
  held AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'summary') AS section FROM headed),
  owned AS (SELECT *, count(*) FILTER (section = 'experience' AND heading IS NULL) OVER (PARTITION BY doc_id) AS n_own FROM held),
  lettered AS (SELECT *, CASE WHEN left(s, 1) IN ('-', '•', '·', '*') OR NOT (span <> '' OR (titled AND (contains(s, '|') OR words <= 8)) OR {_matches('s', '^(.{3,60}?)\\s+(?:at|@|,)\\s+(.{2,60})$')}) THEN '-'
      WHEN len(parts) >= 2 THEN CASE WHEN span <> '' THEN 'f' ELSE 's' END WHEN span <> '' THEN 'c' ELSE 'b' END
    || CASE WHEN words > 4 THEN 'o' WHEN span <> '' THEN 'w' WHEN left(s, 1) IN ('-', '•') OR titled THEN 'o' ELSE 'n' END AS letters
    FROM owned WHERE s <> '' AND (n_own = 0 OR (section = 'experience' AND heading IS NULL))),
  marked AS (SELECT doc_id, string_agg(letters, '' ORDER BY pos) AS marks, list(struct_pack(s := s, span := span, parts := parts) ORDER BY pos) AS own FROM lettered GROUP BY doc_id),
  matched AS (SELECT *, regexp_extract_all(marks, '{_JOB}') AS found, regexp_extract_all(marks, '{_JOB}', 1) AS heads FROM marked),
  placed AS (SELECT doc_id, marks, own, found, unnest(generate_series(1, least(len(found), 10))) AS k, heads FROM matched),
  looked AS (SELECT doc_id, k, own, heads[k] AS head, ((length(marks) - list_sum(list_transform(found, lambda f: length(f))) + coalesce(list_sum(list_transform(found[1:k-1], lambda f: length(f))), 0)) / 2)::BIGINT + 1 AS here,
    length(found[k]) // 2 AS n FROM placed),
  told AS (SELECT doc_id, k, coalesce(own[here].parts[1], trim(regexp_replace(replace(own[here].s, CASE WHEN own[here].span = '' THEN chr(1) ELSE own[here].span END, ' '), '[()]', ' ', 'g'), ' ,-|')) AS title,
    CASE WHEN len(own[here].parts) > 1 THEN own[here].parts[2] WHEN head[4] = 'n' THEN own[here + 1].s WHEN head[6] = 'n' THEN own[here + 2].s ELSE '' END AS company,
    CASE WHEN own[here].span <> '' THEN own[here].span WHEN head[4] = 'w' THEN own[here + 1].s WHEN head[6] = 'w' THEN own[here + 2].s ELSE '' END AS dates,
    left(trim(array_to_string(list_transform(own[here + length(head) // 2 : here + n - 1], lambda x: x.s), ' ')), 800) AS body FROM looked),
  dated AS (SELECT *, regexp_extract(dates, '{_SPAN}', 1) AS y0, regexp_extract(regexp_extract(dates, '{_SPAN}', 2), '^\\d+$') AS y1 FROM told),
  jobs AS (SELECT doc_id, count(*)::INTEGER AS n_jobs, string_agg(left(trim(title), 60) || '@' || left(trim(company), 60) || '@' || y0 || '@' || y1, '|' ORDER BY k) AS jobs,
    sha256(string_agg(body, chr(10) ORDER BY k)) AS bodies_sha256, sum(CASE WHEN y0 = '' THEN 0 ELSE greatest(0, CASE WHEN y1 = '' THEN 12 * 2026 + 6 ELSE 12 * y1::BIGINT + 1 END - 12 * y0::BIGINT - 1) END)::BIGINT AS months
    FROM dated GROUP BY doc_id),
  counted AS (SELECT doc_id, count(*) FILTER (section = 'education' AND heading IS NULL AND s <> '')::INTEGER AS n_school_lines, count(*) FILTER (heading IS NOT NULL)::INTEGER AS n_headings, count(*)::INTEGER AS n_lines FROM held GROUP BY doc_id)
SELECT c.doc_id, c.n_lines, c.n_headings, c.n_school_lines, coalesce(m.marks, '') AS marks, coalesce(j.n_jobs, 0)::INTEGER AS n_jobs, coalesce(j.jobs, '') AS jobs,
  coalesce(j.bodies_sha256, sha256('')) AS bodies_sha256, coalesce(j.months, 0)::BIGINT AS months FROM counted c LEFT JOIN marked m ON c.doc_id = m.doc_id LEFT JOIN jobs j ON c.doc_id = j.doc_id""")
def q61(spark, sf):
    """Resumes to lines, sections, the kinds of all lines of the career, and the jobs that those tell of."""
    texts = read(spark, sf, "documents").select("doc_id", F.expr(RESUME).alias("resume"))
    rows = resume_columns.described(texts, "resume").withColumn("_jobs", resume_columns.jobs(F.col("_lines")))
    year = lambda c: F.coalesce(F.left(c, F.lit(4)), F.lit(""))
    shown = F.transform("_jobs", lambda j: F.concat_ws("@", j["title"], j["company"], year(j["start_date"]), year(j["end_date"])))
    return rows.select(
        "_row.doc_id", F.size("_every").alias("n_lines"), F.size(F.filter("_every", lambda x: x["heading"].isNotNull())).alias("n_headings"),
        F.size(resume_columns.told(F.col("_under.education"))).alias("n_school_lines"), resume_columns.marks(F.col("_lines")).alias("marks"),
        F.size("_jobs").alias("n_jobs"), F.array_join(shown, "|").alias("jobs"), F.sha2(F.array_join(F.transform("_jobs", lambda j: j["description"]), "\n"), 256).alias("bodies_sha256"),
        F.aggregate("_jobs", F.lit(0).cast("long"), lambda a, j: a + j["duration_months"]).alias("months"),
    )
