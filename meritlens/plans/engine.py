"""The ranking facade: one job or many, over records, files or DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritlens.functions import scalars as sc
from meritlens.functions.text import fingerprint
from meritlens.operators import audits, explain, matching, ranking, requirements, scoring, signals
from meritlens.operators.features import features
from meritlens.operators.jobs import JobTable
from meritlens.operators.requirements import Spec
from meritlens.sources import readers, sinks

API_VERSION = "1.0.0"
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class RankResult:
    """The head of a ranking with reasons, and what was done."""

    spec: Spec
    engine: str
    head: DataFrame
    pool: DataFrame
    notes: tuple[str, ...] = ()
    api_version: str = API_VERSION

    def collect(self) -> list[dict[str, Any]]:
        columns = ["rank", "candidate_id", "display_score", "reasoning", "risk_flags"]
        return [r.asDict(recursive=True) for r in self.head.select(*columns).orderBy("rank").collect()]


def resolve_job(job: Spec | Mapping | str, category: str = "ai_ml_search_ranking", title: str = "") -> Spec:
    """A Spec from a Spec, a scorecard, a path (.yaml, .md, .txt) or free text."""
    if isinstance(job, Spec):
        return job
    if isinstance(job, Mapping):
        return requirements.spec_from_dict(job)
    text = str(job)
    if "\n" not in text and text.lower().endswith((".yaml", ".yml")):
        return requirements.spec_from_dict(requirements.parse_simple_yaml(Path(text).read_text(encoding="utf-8")))
    if "\n" not in text and text.lower().endswith((".md", ".txt")):
        text = Path(text).read_text(encoding="utf-8")
    return requirements.spec_from_text(text, category=category, title=title)


def embed_column(texts: DataFrame, column: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    """``texts`` with vectors from an injected model, a batch of rows at a time."""
    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embedder(values.fillna("").tolist())])

    return texts.withColumn(out, run(F.col(column)))


def score_pool(
    candidates: DataFrame,
    spec: Spec,
    engine: str = "spine",
    index: DataFrame | None = None,
    embedded: Sequence[Sequence[float]] | None = None,
    embedder: Embedder | None = None,
) -> DataFrame:
    """All candidates scored; none is dropped.

    The hybrid engine takes vectors from ``index`` (candidate_id, vec) by a left join, so that a
    candidate without one is matched by words alone, or from ``embedder``."""
    rows = audits.audited(features(candidates))
    if engine == "spine":
        return scoring.score_lexical(rows, spec)
    if engine != "hybrid":
        raise ValueError("engine must be spine or hybrid")
    vector = None
    if index is not None:
        rows, vector = rows.join(index.select("candidate_id", "vec"), "candidate_id", "left"), "vec"
    elif embedder is not None:
        rows, vector = embed_column(rows, "match_text", embedder), "vec"
        embedded = embedder([r.text for r in spec.requirements])
    rows = rows.withColumns({
        "matches": matching.matches(spec.requirements, vector=vector, embedded=embedded),
        "schema_signals": signals.schema_signals(),
    })
    return scoring.score_hybrid(rows.withColumn("fit", matching.summary()), spec)


def rank_pool(scored: DataFrame, spec: Spec, top_n: int = 100) -> DataFrame:
    """The head with rank, display score and reasons; those are made for the head alone.

    The head is kept, as every later step that takes it up again would score the whole pool once more."""
    head = ranking.top(scored, top_n, ranking.rank_order()).cache()
    shown = ranking.display_scores(head)
    return explain.reasons(ranking.with_neighbour(shown, [*explain.FACTOR_LABELS, "candidate_id"]), spec)


def rank(
    spark: SparkSession,
    job: Spec | Mapping | str,
    candidates: DataFrame | Any,
    *,
    top_n: int = 100,
    engine: str = "hybrid",
    category: str = "ai_ml_search_ranking",
    title: str = "",
    index: DataFrame | None = None,
    embedded: Sequence[Sequence[float]] | None = None,
    embedder: Embedder | None = None,
    second_score: Callable[[DataFrame], DataFrame] | None = None,
    rerank_k: int = 50,
) -> RankResult:
    """Rank candidates (rows, records, files, texts) for a job.

    ``second_score`` adds a column ``second`` to the head's first ``rerank_k`` rows (a cross-encoder);
    if it fails, the ranking stays and a note says so."""
    spec = resolve_job(job, category, title)
    rows = candidates if isinstance(candidates, DataFrame) else readers.ingest(spark, candidates)
    notes = []
    if engine == "hybrid" and index is None and embedder is None:
        notes.append("no vectors: matched by words alone")
    pool = score_pool(rows, spec, engine, index, embedded, embedder)
    head, more = _finished(pool, spec, top_n, second_score, rerank_k)
    return RankResult(spec, engine, head, pool, (*notes, *more))


def _finished(scored: DataFrame, spec: Spec, top_n: int, second_score: Callable[[DataFrame], DataFrame] | None, rerank_k: int) -> tuple[DataFrame, list[str]]:
    """The head of scored rows, reranked if a second score is given, and notes."""
    head = rank_pool(scored, spec, top_n)
    if second_score is None:
        return head, []
    try:
        again = ranking.rerank(second_score(head), "second", rerank_k)
        return again.drop("rank").withColumnRenamed("new_rank", "rank"), []
    except Exception as error:  # noqa: BLE001  the first ranking is still good
        return head, [f"not reranked: {type(error).__name__}"]


def rank_file(spark: SparkSession, job: Any, path: str, **options) -> RankResult:
    """:func:`rank` over a file of JSON lines, read strictly."""
    return rank(spark, job, readers.read_candidates(spark, path), **options)


def rank_many(spark: SparkSession, jobs: Mapping[str, Any], candidates: DataFrame, *, top_n: int = 100, categories: Mapping[str, str] | None = None) -> DataFrame:
    """(job_id, rank, candidate_id, final_score) of many jobs over one pool.

    Jobs are rows of a table, not expressions: features are worked out once a row, then each row meets, of one
    constant array, the jobs that share a word with it, and the heads of all jobs come from one group limit.  The
    plan is the same for two jobs and for a thousand.  All other pairs score 0 and go by reachability
    and id; those that could be in a head are among the pool's first ``top_n`` by these, which meet all jobs."""
    specs = {name: resolve_job(job, (categories or {}).get(name, "ai_ml_search_ranking")) for name, job in jobs.items()}
    rows, every = audits.audited(features(candidates)), JobTable.rows(specs)
    touched = JobTable.touching(every, "tokens", "career_tokens", "title_tokens")
    reach = sc.reachability(F.col("last_active_months"), F.col("response_rate"), F.col("open_to_work"))["score"]
    first = rows.withColumn("_reach", reach).orderBy(F.col("_reach").desc(), "candidate_id").limit(top_n).drop("_reach")
    pairs = rows.withColumn("_job", F.explode(touched)).unionByName(first.withColumn("_job", F.explode(F.array_except(every, touched))))
    scored = scoring.score_lexical(pairs, JobTable("_job"))
    listed = scored.select("candidate_id", "title", "_job.job_id", "final_score", F.col("reach.score").alias("reach"), "risk_flags")
    head = ranking.top(listed, top_n, ranking.rank_order(reach="reach"), by=["job_id"])
    return head.select("job_id", "rank", "candidate_id", "final_score", "title", "risk_flags")


def rank_to_csv(spark: SparkSession, job: Any, candidates: Any, path: str, **options) -> RankResult:
    result = rank(spark, job, candidates, **options)
    sinks.write_ranking(result.head, path)
    return result


def content(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums of row hashes: independent of row order, and of a union the sums."""
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    sums = (F.coalesce(F.sum(F.xxhash64(whole, F.lit(k)).cast("decimal(38,0)")), F.lit(0)) for k in (1, 2))
    return tuple(map(int, rows.agg(F.count("*"), *sums).first()))


def pool_fingerprint(candidates: DataFrame) -> str:
    """Digest of a pool's scored fields, independent of row order."""
    return hashlib.sha1(":".join(map(str, _scored_content(candidates))).encode()).hexdigest()[:16]


def _scored_content(candidates: DataFrame) -> tuple[int, int, int]:
    return content(candidates.select(fingerprint(*(F.col(c) for c in ("candidate_id", "profile", "career_history", "skills", "signals"))).alias("row")))


def option_key(value: Any) -> Any:
    """What stands for an option: DataFrames go by content, plain values by themselves, functions by identity."""
    if value is None or isinstance(value, (str, bool, int, float)):
        return (type(value).__name__, value)
    if isinstance(value, Spec):
        return ("spec", *(option_key(getattr(value, f.name)) for f in fields(value)))
    if isinstance(value, requirements.Requirement):
        return ("requirement", *(option_key(getattr(value, f.name)) for f in fields(value)))
    if isinstance(value, DataFrame):
        return ("rows", tuple(value.columns), content(value))
    if isinstance(value, Mapping):
        return ("mapping", tuple(sorted((str(k), option_key(v)) for k, v in value.items())))
    if isinstance(value, (list, tuple)):
        return ("list", tuple(map(option_key, value)))
    if callable(value):
        return value
    raise TypeError(f"no cache key for an option of type {type(value).__name__}")


class Cache:
    """Heads kept by job, options and content of the pool, until invalidated.

    A head goes with the scored rows that it was made of (as many as the head has), so that rows that
    are added to a pool are scored alone and meet those."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.kept: dict[tuple, DataFrame] = {}
        self.scored: dict[tuple, tuple[Spec, DataFrame]] = {}

    def _key(self, job: Any, options: Mapping[str, Any], pool: tuple[int, int, int]) -> tuple:
        return (option_key(job), option_key(options), pool)

    def _keep(self, key: tuple, spec: Spec, head: DataFrame, scored: DataFrame, top_n: int) -> DataFrame:
        self.scored[key] = (spec, ranking.top(scored, top_n, ranking.rank_order()).drop("rank").cache())
        self.kept[key] = head.cache()
        return self.kept[key]

    def rank(self, job: Any, candidates: DataFrame, **options) -> DataFrame:
        key = self._key(job, options, _scored_content(candidates))
        if key not in self.kept:
            found = rank(self.spark, job, candidates, **options)
            return self._keep(key, found.spec, found.head, found.pool, options.get("top_n", 100))
        return self.kept[key]

    def append(self, job: Any, candidates: DataFrame, added: DataFrame, **options) -> DataFrame:
        """The head of ``candidates`` and ``added`` together; if that of ``candidates`` is kept, only ``added`` is scored.

        A candidate's score depends on no other row, so the head of the union is among both heads."""
        old, new = _scored_content(candidates), _scored_content(added)
        key = self._key(job, options, tuple(a + b for a, b in zip(old, new)))
        before = self._key(job, options, old)
        if key in self.kept:
            return self.kept[key]
        if before not in self.scored:
            return self.rank(job, candidates.unionByName(added), **options)
        spec, scored = self.scored[before]
        top_n = options.get("top_n", 100)
        fresh = rank(self.spark, spec, added, **{k: v for k, v in options.items() if k not in ("second_score", "rerank_k")}).pool
        both = scored.unionByName(fresh)
        head, _ = _finished(both, spec, top_n, options.get("second_score"), options.get("rerank_k", 50))
        return self._keep(key, spec, head, both, top_n)

    def invalidate(self) -> None:
        for df in (*self.kept.values(), *(rows for _, rows in self.scored.values())):
            df.unpersist()
        self.kept.clear()
        self.scored.clear()
