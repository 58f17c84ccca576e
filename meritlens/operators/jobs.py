"""What scoring asks of a job: literals of one scorecard, or columns of a table of scorecards."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from meritlens.functions import scalars as sc
from meritlens.functions import text as tx
from meritlens.operators.requirements import Spec

AI_CATEGORY = "ai_ml_search_ranking"


def texts_of(spec: Spec) -> dict[str, tuple[str, ...]]:
    return {"must": spec.must, "nice": spec.nice, "disqualifiers": spec.disqualifiers, "title": (spec.title,)}


class OneJob:
    """A scorecard whose values become literals, so that a pool is scored without a join."""

    def __init__(self, spec: Spec):
        self.texts = texts_of(spec)
        self.ai, self.has_must = spec.category == AI_CATEGORY, bool(spec.must)
        self.country, self.cities = F.lit(spec.country.lower()), tx.strings([c.lower() for c in spec.locations])
        self.preferred, self.strongest = spec.preferred, spec.strongest
        self.weights, self.total = spec.weights, None

    def coverage(self, tokens: str, kind: str) -> Column:
        return tx.term_coverage(tokens, self.texts[kind])

    def pick(self, flag: bool, yes: Callable[[], Column], no: Callable[[], Column]) -> Column:
        return yes() if flag else no()


class JobTable:
    """Scorecards in a struct column, one for each row; the plan is the same for any number of jobs."""

    SCHEMA = (
        "job_id string, ai boolean, country string, cities array<string>, preferred array<double>, strongest array<double>, "
        "weights array<double>, total double, must array<array<string>>, nice array<array<string>>, "
        "disqualifiers array<array<string>>, title array<array<string>>, words array<string>"
    )

    def __init__(self, column: str):
        own = lambda field: F.col(f"{column}.{field}")
        self.own, self.ai, self.has_must = own, own("ai"), F.size(own("must")) > 0
        self.country, self.cities = own("country"), own("cities")
        self.preferred, self.strongest = ((own(f)[0], own(f)[1]) for f in ("preferred", "strongest"))
        self.weights = {k: own("weights")[i] for i, k in enumerate(sc.GENERIC)}
        self.total = own("total")

    @classmethod
    def rows(cls, specs: Mapping[str, Spec]) -> Column:
        """The jobs as one constant array of structs."""
        return F.from_json(F.lit(json.dumps([cls._row(name, spec) for name, spec in specs.items()])), f"array<struct<{_typed(cls.SCHEMA)}>>")

    @staticmethod
    def _row(name: str, spec: Spec) -> dict[str, Any]:
        weights = [float(spec.weights.get(k, 0.0)) for k in sc.GENERIC]
        return {
            "job_id": name, "ai": spec.category == AI_CATEGORY, "country": spec.country.lower(), "cities": [c.lower() for c in spec.locations],
            "preferred": [float(x) for x in spec.preferred], "strongest": [float(x) for x in spec.strongest],
            "weights": weights, "total": sum(weights) or 1.0,
            "words": sorted({w for t in (*spec.must, *spec.nice, spec.title) for w in tx.term_words(t)}),
        } | {k: [tx.term_words(t) for t in terms] for k, terms in texts_of(spec).items()}

    @staticmethod
    def touching(jobs: Column, *tokens: str) -> Column:
        """Those of ``jobs`` that may give a row with these token sets a score: a job whose must, nice and title words
        the row has none of scores 0, if it asks for anything at all."""
        met = lambda job: reduce(Column.__or__, (F.arrays_overlap(t, job["words"]) for t in tokens))
        return F.filter(jobs, lambda job: met(job) | (F.size(job["must"]) == 0))

    def coverage(self, tokens: str, kind: str) -> Column:
        return tx.coverage_of(tokens, self.own(kind))

    def pick(self, flag: Column, yes: Callable[[], Column], no: Callable[[], Column]) -> Column:
        return F.when(flag, yes()).otherwise(no())


Job = OneJob | JobTable


def job_of(spec: Spec | Job) -> Job:
    return OneJob(spec) if isinstance(spec, Spec) else spec


def _typed(schema: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return ", ".join(f"{name}:{kind}" for name, kind in (field.split(" ", 1) for field in schema.split(", ")))
