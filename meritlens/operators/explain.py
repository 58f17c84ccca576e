"""Reasons, evidence packets, comparisons and reports for the head of a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions import lexicons as lx
from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.functions.text import strings
from meritlens.operators.matching import top_matches
from meritlens.operators.requirements import Spec

FACTOR_LABELS = {
    "technical_evidence": "Skills", "career_fit": "Experience", "seniority": "Seniority", "logistics": "Location & logistics",
    "behavioral": "Availability", "trust": "Credibility", "confidence": "Strength of evidence",
}
CLEAR_LEAD = 0.08
TRAP_LABELS = {
    "non_tech_ai_keyword_stuffing": "AI keywords on a non-technical profile",
    "ai_terms_without_career_evidence": "AI terms that no job supports",
    "expert_skills_zero_duration": "expert skills without any time of use",
    "service_only_without_product_search_evidence": "service companies only, no product or search work",
    "stale_low_response": "inactive, seldom replies",
    "shallow_ai_tool_interest": "interest in AI tools without applied work",
}

#: Openers by rank band; a row's variant follows from its id and rank.
OPENERS = {
    "top": ("Leads the list.", "Among the strongest matches here.", "A clear early call."),
    "high": ("A strong match.", "Well above most of the list.", "Worth an early conversation."),
    "mid": ("A fair match.", "Fits part of the role.", "Worth a second look."),
    "low": ("A partial match.", "Near the edge of the list.", "Fits in places only."),
}


def band() -> Column:
    r = F.col("rank")
    return F.when(r <= 5, "top").when(r <= 20, "high").when(r <= 60, "mid").otherwise("low")


def variant(options: tuple[str, ...], key: str = "candidate_id") -> Column:
    """One of the options, by the sum of the id's code points and the rank."""
    seed = F.aggregate(F.transform(F.split(F.col(key), ""), lambda c: F.ascii(c)), F.col("rank").cast("int"), lambda a, x: a + x)
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(seed, F.lit(len(options))) + 1)


def leading_factor(other: str = "neighbour") -> Column:
    """The first factor, in factor order, in which a row leads the next one clearly, as a label."""
    leads = F.array_compact(F.array(*(
        F.when(F.col(k) - F.col(f"{other}.{k}") >= CLEAR_LEAD, label) for k, label in FACTOR_LABELS.items()))
    )
    return F.try_element_at(leads, F.lit(1))


def reasons(ranked: DataFrame, spec: Spec) -> DataFrame:
    """A ranked head (with ``neighbour``) with ``reasoning``, built only from the row's own evidence."""
    openers = F.lit("")
    for name, options in OPENERS.items():
        openers = F.when(band() == name, variant(options)).otherwise(openers)
    must = strings([w for t in spec.must for w in tx.keywords_of(t)])
    terms = F.array_join(F.slice(F.array_distinct(F.array_union(
        F.filter(must, lambda w: F.array_contains("tokens", w)), F.array_intersect("career_retrieval_terms", "tokens"))), 1, 4), ", ")
    shown = F.when(F.length(terms) > 0, terms).otherwise("related work")
    role = F.when(F.trim("title") != "", F.concat(F.col("title"), F.lit(", "))).otherwise("")
    years = F.format_string("%.1f years", F.col("years"))
    relevance = F.col("role_relevance")
    strength = F.concat(
        role, years,
        F.when(relevance >= 0.7, "; covers most of what the role asks for: ").when(relevance >= 0.45, "; covers much of the role: ")
        .when(relevance >= 0.25, "; covers some of the role: ").otherwise("; covers little of the role: "), shown, F.lit("."),
    )
    lead = leading_factor()
    compared = F.when(
        (F.col("rank") <= 25) & lead.isNotNull(),
        F.concat(F.lit("Ahead of #"), (F.col("rank") + 1).cast("string"), F.lit(" on "), F.lower(lead), F.lit(".")),
    )
    label = F.col("reach.label")
    reach = F.when(
        band().isin("top", "high"),
        F.when(label == "reachable", "Likely to answer.").when(label == "stale", "Has been inactive for long.")
        .when(label == "passive", "Not looking, but active."),
    )
    concerns = F.array_join(F.slice(F.transform("risk_flags", lambda f: F.regexp_replace(f, "_", " ")), 1, 2), "; ")
    caution = F.when(F.size("risk_flags") > 0, F.concat(F.lit("To check: "), concerns, F.lit("."))).when(
        band() == "low", "Check the main requirements before a call."
    )
    none = F.array_contains("risk_flags", "insufficient_evidence")
    text = F.concat_ws(" ", openers, strength, compared, reach, caution)
    return ranked.withColumn("reasoning", F.when(none, "The record has too little usable data to assess; check its format.").otherwise(F.substring(text, 1, 500)))


def packets(ranked: DataFrame) -> DataFrame:
    """One nested row for each ranked row: scores, evidence and flags."""
    scores = [c for c in (*lx.FACTORS, "final_score", "confidence", "penalty", "role_relevance", "general_quality", "requirement_coverage",
                          "semantic_fit", "lexical_fit", "top10_eligible", "risk_flags", "engine") if c in ranked.columns]
    evidence = ("title", "years", "location", "country", "career_retrieval_terms", "career_production_terms", "vector_terms", "eval_terms",
                "skill_ml_terms", "skill_names")
    matched = top_matches() if "matches" in ranked.columns else F.array()
    return ranked.select(
        "candidate_id", "rank", F.format_string("%.6f", F.col("display_score")).alias("score"), "reasoning",
        F.struct(*scores).alias("score_breakdown"), F.struct(*evidence).alias("evidence"), matched.alias("matched_requirements"),
        F.col("reach").alias("reachability"), "concern_notes",
    )


def _factors(prefix: str) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("factor"), F.lit(v).alias("label"), F.col(f"{prefix}.{k}").alias("value"), F.lit(-i).alias("o"))
                     for i, (k, v) in enumerate(FACTOR_LABELS.items())))


def extreme_factor(prefix: str, strongest: bool = True) -> Column:
    """The factor of the highest (or lowest) value; the first of equals in factor order."""
    sign = 1.0 if strongest else -1.0
    rated = F.transform(_factors(prefix), lambda f: F.struct((f["value"] * sign).alias("v"), f["o"].alias("o"), f.alias("f")))
    return F.array_max(rated)["f"]


def compare(ranked: DataFrame, left: int, right: int) -> DataFrame:
    """One row on two ranks: differences by size, strongest factors and who stays ahead on what."""
    keep = F.struct("candidate_id", "rank", "final_score", *FACTOR_LABELS)
    a = ranked.where(F.col("rank") == left).select(F.lit(1).alias("k"), keep.alias("l"))
    b = ranked.where(F.col("rank") == right).select(F.lit(1).alias("k"), keep.alias("r"))
    deltas = F.array(*(
        F.struct((-F.abs(F.col(f"l.{k}") - F.col(f"r.{k}"))).alias("size"), F.lit(i).alias("o"), F.lit(k).alias("factor"), F.lit(v).alias("label"),
                 F.round(F.col(f"l.{k}") - F.col(f"r.{k}"), 6).alias("delta")) for i, (k, v) in enumerate(FACTOR_LABELS.items())))
    left_wins = F.col("l.final_score") >= F.col("r.final_score")
    ordered = F.sort_array(deltas)
    main = F.try_element_at(F.filter(ordered, lambda d: (d["delta"] != 0) & ((d["delta"] > 0) == left_wins)), F.lit(1))["label"]
    return a.join(b, "k").select(
        F.col("l.candidate_id").alias("left_id"), F.col("r.candidate_id").alias("right_id"),
        F.round(F.col("l.final_score") - F.col("r.final_score"), 6).alias("score_delta"),
        F.transform(ordered, lambda d: F.struct(d["factor"], d["label"], d["delta"])).alias("deltas"),
        extreme_factor("l")["factor"].alias("left_strongest"), extreme_factor("r")["factor"].alias("right_strongest"),
        extreme_factor("l", False)["factor"].alias("left_weakest"), extreme_factor("r", False)["factor"].alias("right_weakest"),
        F.when(left_wins, F.col("l.candidate_id")).otherwise(F.col("r.candidate_id")).alias("winner"), main.alias("main_difference"),
    )


def traps(scored: DataFrame, limit: int = 5) -> DataFrame:
    """Flagged rows that words alone would rank well: within the first hundred first, then by penalty."""
    strength = F.size("retrieval_terms") + F.size("vector_terms") + F.size("ml_terms")
    labels = F.create_map(*(F.lit(x) for kv in TRAP_LABELS.items() for x in kv))
    reason = F.array_join(F.transform("risk_flags", lambda f: F.coalesce(F.try_element_at(labels, f), f)), "; ")
    terms = F.slice(F.concat("retrieval_terms", "vector_terms", "ml_terms"), 1, 6)
    rows = scored.where((F.size("risk_flags") > 0) & (strength >= 3)).select(
        "candidate_id", "rank", F.col("final_score").alias("score"), "title", reason.alias("reason"), "risk_flags", "penalty", terms.alias("evidence_terms")
    )
    return rows.orderBy((F.col("rank") <= 100).desc(), F.col("penalty").desc(), F.col("rank")).limit(limit)


def transparency(scored: DataFrame, candidate_id: str, spec: Spec) -> DataFrame:
    """One candidate's report: scores, what was matched and what was not (first six)."""
    row = scored.where(F.col("candidate_id") == candidate_id)
    must = strings(spec.must)
    if "matches" in scored.columns:
        have = F.transform(F.filter("matches", lambda m: m["score"] >= 0.30), lambda m: m["text"])
    else:
        have = F.filter(must, lambda t: F.exists(F.split(F.lower(t), r"[\s/\-]+"), lambda w: F.array_contains("tokens", w)))
    return row.select(
        "candidate_id", "rank", "final_score", *lx.FACTORS, have.alias("met"), F.slice(F.array_except(must, have), 1, 6).alias("unmet"),
        "risk_flags", "concern_notes", F.col("reach.label").alias("reachability"),
    )


def interview_questions(packets_: DataFrame, spec: Spec) -> DataFrame:
    """(candidate_id, n, question): on matched requirements, on unmet ones and on concerns."""
    met = F.transform("matched_requirements", lambda m: F.concat(F.lit("Tell us about your work on "), m["text"], F.lit(".")))
    texts = F.transform("matched_requirements", lambda m: m["text"])
    unmet = F.slice(F.array_except(strings(spec.must), texts), 1, 3)
    gaps = F.transform(unmet, lambda t: F.concat(F.lit("How would you approach "), t, F.lit("?")))
    doubts = F.transform("concern_notes", lambda n: F.concat(F.lit("Please explain: "), n))
    return packets_.select("candidate_id", F.posexplode(F.concat(met, gaps, doubts)).alias("n", "question"))


def decision() -> Column:
    """struct(decision, concerns) of a ranked row: keep, or investigate where the place is prominent.

    Any concern counts within the first ten, flags alone within the first twenty-five."""
    top, flagged = F.col("rank") <= 10, F.size("risk_flags") > 0
    concerns = sc.present(
        (top & ~F.col("top10_eligible"), "not eligible for the first ten"),
        (F.size("career_retrieval_terms") == 0, "no retrieval or ranking in the career"),
        (F.size("career_production_terms") == 0, "little production work in the career"),
        (flagged, "risk flags"),
    )
    look = (top & (F.size(concerns) > 0)) | ((F.col("rank") <= 25) & flagged)
    return F.struct(F.when(look, "investigate").otherwise("keep").alias("decision"), concerns.alias("concerns"))


def fit_label() -> Column:
    """Verdict by relevance tier."""
    r = F.col("role_relevance")
    return F.when(r >= 0.7, "strong").when(r >= 0.45, "good").when(r >= 0.25, "partial").otherwise("weak")


def hidden_fit() -> Column:
    """Meaning fits where words do not."""
    return (F.col("semantic_fit") >= 0.5) & (F.col("lexical_fit") < 0.3)


def occurrences(text: Column, words: tuple[str, ...] = lx.COUNTED_KEYWORDS) -> Column:
    """How often the words occur anywhere in a text, summed: a naive rank to compare with."""
    return sum((F.size(F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lit(w), F.lit(r"\E")))) - 1 for w in words), F.lit(0))
