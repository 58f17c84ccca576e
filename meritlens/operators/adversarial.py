"""Attacks on a ranking and invariance checks, over whole pools at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meritlens.functions import scalars as sc
from meritlens.operators import evaluation
from meritlens.operators.requirements import Spec

Scorer = Callable[[DataFrame], DataFrame]
Change = Callable[[DataFrame], DataFrame]
NAMES = ("Aarav Sharma", "Mary Johnson", "Wei Zhang")


def _profile(df: DataFrame, **changes) -> DataFrame:
    profile = F.col("profile")
    for field, value in changes.items():
        profile = profile.withField(field, value)
    return df.withColumn("profile", profile)


def keyword_stuffing(df: DataFrame, spec: Spec) -> DataFrame:
    """All requirement texts pasted into the summary."""
    return _profile(df, summary=F.concat_ws(" ", F.col("profile.summary"), F.lit(" ".join([*spec.must, *spec.nice]))))


def skill_stuffing(df: DataFrame, spec: Spec) -> DataFrame:
    """Every requirement listed as an expert skill that was never used."""
    kind = df.schema["skills"].dataType.simpleString()
    added = F.array(*(F.struct(F.lit(t).alias("name"), F.lit("expert").alias("proficiency"), F.lit(0).alias("endorsements"),
                               F.lit(0).alias("duration_months")) for t in spec.must)).cast(kind)
    return df.withColumn("skills", F.concat("skills", added))


def fabricated_experience(df: DataFrame, spec: Spec) -> DataFrame:
    """Each job claims ten more years."""
    longer = F.transform("career_history", lambda j: j.withField("duration_months", F.coalesce(j["duration_months"], F.lit(0)) + 120))
    return df.withColumn("career_history", longer)


def title_inflation(df: DataFrame, spec: Spec) -> DataFrame:
    """The job's title as the current one."""
    return _profile(df, current_title=F.lit(spec.title), headline=F.lit(spec.title))


ATTACKS = {f.__name__: f for f in (keyword_stuffing, skill_stuffing, fabricated_experience, title_inflation)}


def variants(candidates: DataFrame, changes: Sequence[Change], score: Scorer, columns: Sequence[str]) -> DataFrame:
    """``candidates`` with ``_v0``, ``_v1``..: a struct of the scored ``columns`` for each change.

    Every variant is worked out beside the others in the same row, so that a pool is scanned once and
    neither shuffled nor joined with itself.  ``score`` must keep the columns it is given."""
    kept: list[str] = []
    rows = candidates.select(F.struct(*(F.col(f"`{c}`") for c in candidates.columns)).alias("_row"))
    for k, change in enumerate(changes):
        scored = score(change(rows.select("_row.*", "_row", *kept)))
        rows = scored.select("_row", *kept, F.struct(*columns).alias(f"_v{k}"))
        kept.append(f"_v{k}")
    return rows.select("_row.*", *kept)


def _same(df: DataFrame) -> DataFrame:
    return df


def attack_pairs(candidates: DataFrame, spec: Spec, score: Scorer) -> DataFrame:
    """(attack, candidate_id, score_before, score_after, flagged) of each attack on each candidate."""
    changes = [_same, *(partial(attack, spec=spec) for attack in ATTACKS.values())]
    rows = variants(candidates, changes, score, ("final_score", "risk_flags"))
    before = F.col("_v0")
    tried = F.array(*(
        F.struct(
            F.lit(name).alias("attack"), before["final_score"].alias("score_before"), F.col(f"_v{k}.final_score").alias("score_after"),
            (F.size(F.array_except(F.col(f"_v{k}.risk_flags"), before["risk_flags"])) > 0).alias("flagged"),
        )
        for k, name in enumerate(ATTACKS, 1)
    ))
    listed = rows.select("candidate_id", F.explode(tried).alias("x"))
    return listed.select("x.attack", "candidate_id", "x.score_before", "x.score_after", "x.flagged")


def resistance(candidates: DataFrame, spec: Spec, score: Scorer) -> DataFrame:
    return evaluation.attack_rates(attack_pairs(candidates, spec, score))


def name_changes(candidates: DataFrame, score: Scorer) -> DataFrame:
    """(name, largest) score change when a person's name is put into headline and summary."""
    changes = [_same, *(partial(_named, name=name) for name in NAMES)]
    rows = variants(candidates, changes, score, ("final_score",))
    change = lambda k: F.abs(F.col(f"_v{k}.final_score") - F.col("_v0.final_score"))
    most = rows.agg(F.array(*(F.struct(F.lit(name).alias("name"), F.max(change(k)).alias("largest")) for k, name in enumerate(NAMES, 1))).alias("all"))
    return most.select(F.explode("all").alias("x")).select("x.*")


def _named(df: DataFrame, name: str) -> DataFrame:
    return _profile(df, **{f: F.concat_ws(" ", F.lit(name), F.col(f"profile.{f}")) for f in ("headline", "summary")})


def location_effect(candidates: DataFrame, places: list[tuple[str, str]], score: Scorer) -> DataFrame:
    """(candidate_id, spread): how far the logistics factor moves between places, which is meant to be seen."""
    changes = [partial(_profile, location=F.lit(city), country=F.lit(country)) for city, country in places]
    rows = variants(candidates, changes, score, ("logistics",))
    moved = F.array(*(F.col(f"_v{k}.logistics") for k in range(len(places))))
    return rows.select("candidate_id", sc.rounded(F.array_max(moved) - F.array_min(moved), 4).alias("spread"))
