import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from meritlens.functions import lexicons
from meritlens.operators import adversarial, audits, evaluation, explain, profiling, ranking, requirements, signals, synthetic
from meritlens.operators.features import features
from meritlens.plans import engine, reports
from meritlens.sources import readers, sinks
from meritlens.sources.schema import from_json_lines


def rows_of(spark, *records):
    return from_json_lines(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string"))


def person(**changes):
    base = {
        "candidate_id": "c1",
        "profile": {"summary": "Works on search.", "headline": "Engineer", "current_title": "Engineer", "years_of_experience": 6.0, "country": "India", "location": "Pune"},
        "career_history": [
            {"title": "Engineer", "company": "A", "start_date": "2020-01-01", "end_date": "2022-01-01", "duration_months": 36, "description": "search"},
            {"title": "Engineer", "company": "B", "start_date": "2022-01-01", "end_date": None, "duration_months": 36, "description": "ranking"},
        ],
        "skills": [{"name": "search", "proficiency": "expert", "duration_months": 24}],
        "signals": {"endorsements_received": 5},
    }
    return {**base, **changes}


def codes(spark, record):
    return audits.audited(features(rows_of(spark, record))).first()


def test_clean_profile_has_no_flags(spark):
    got = codes(spark, person())
    assert got.codes == [] and got.audit_penalty == 0 and not got.impossible


def job(**changes):
    return {"title": "E", "company": "A", "start_date": "2020-01-01", "end_date": "2021-01-01", "duration_months": 12, **changes}


def expert(months, name="search"):
    return {"name": name, "proficiency": "Expert", **({} if months is None else {"duration_months": months})}


PROFILE = person()["profile"]


@pytest.mark.parametrize(
    ("changes", "code", "severity"),
    [
        ({"profile": {**PROFILE, "years_of_experience": 3}, "career_history": [job(duration_months=72)]}, "tenure_exceeds_experience", 0.30),
        ({"skills": [expert(0)]}, "expert_zero_duration", 0.15),
        ({"skills": [expert(0), expert(0)]}, "expert_zero_duration", 0.25),
        ({"profile": {**PROFILE, "years_of_experience": 3}, "career_history": [], "skills": [expert(120)]}, "skill_exceeds_career", 0.20),
        ({"career_history": [job(start_date="2022-01-01", end_date="2020-01-01")]}, "date_integrity", 0.15),
        ({"career_history": [job(start_date="2027-01-01", end_date=None)]}, "date_integrity", 0.15),
        ({"skills": [expert(12, n) for n in ("aaaa", "bbbb", "cccc", "dddd", "eeee")]}, "skill_not_in_evidence", 0.10),
        ({"signals": {}}, "endorsement_inconsistency", 0.08),
    ],
)
def test_consistency(spark, changes, code, severity):
    got = codes(spark, person(**changes))
    assert code in got.codes and severity in [f.severity for f in got.consistency if f.code == code]
    assert got.impossible == any(c in audits.lx.IMPOSSIBLE_CODES for c in got.codes)


def test_missing_duration_is_not_zero_for_the_auditor(spark):
    got = codes(spark, person(skills=[expert(None)]))
    assert "expert_zero_duration" not in got.codes and got.expert_zero_duration == 1


def test_malformed_records_do_not_break(spark):
    odd = [
        {"candidate_id": "a", "profile": None, "career_history": None, "skills": ["python", {"name": "sql"}, None, 3], "signals": None},
        {"candidate_id": "b", "profile": "x", "career_history": {"a": 1}, "skills": "s", "signals": [1]},
        {"id": 3, "name": "n", "experience": 4}, {"foo": "bar"}, '["not", "an object"]', "no json at all", "17",
    ]
    rows = rows_of(spark, *odd)
    assert rows.count() == 4
    got = {r.candidate_id: r for r in engine.score_pool(rows, engine.resolve_job("Cook.\nMust have knives, sauces and stock.")).collect()}
    assert got["a"].skill_names[:2] == ["python", "sql"]
    assert got[None].final_score == 0.0 and "insufficient_evidence" in got[None].risk_flags


def test_open_flag_and_signals(spark):
    def score(signals_):
        return features(rows_of(spark, person(signals=signals_))).first()

    assert score({"open_to_work_flag": False}).open_to_work is False and score({}).open_to_work is None
    neutral = rows_of(spark, person(signals={"colour": "blue"})).select(signals.schema_signals().alias("s")).first().s
    assert tuple(neutral) == (0.5, 0.5, 0.5)
    alt = rows_of(spark, person(signals={"available": True, "days_since_login": 0, "reply_rate": 0.5, "completeness": 80, "is_email_verified": False}))
    assert tuple(alt.select(signals.schema_signals().alias("s")).first().s) == (1.0, 0.5, 0.4)


@pytest.fixture(scope="module")
def pools(spark):
    return {(n, v): tuple(x.cache() for x in synthetic.pool(spark, role, vocabulary=v)) for n, role in synthetic.ROLES.items() for v in (("full", "alt") if n == "search" else ("full",))}


CASES = [(n, k, "full") for n in synthetic.ROLES for k in ("spine", "hybrid")] + [("search", k, "alt") for k in ("spine", "hybrid")]


@pytest.mark.parametrize(("name", "kind", "vocabulary"), CASES)
def test_synthetic_pools_are_ranked_well(spark, pools, name, kind, vocabulary):
    rows, labels = pools[name, vocabulary]
    result = engine.rank(spark, synthetic.ROLES[name].job, rows, engine=kind, top_n=90)
    ranked = result.head.select("candidate_id", "rank").withColumn("q", F.lit("q"))
    got = evaluation.metrics(evaluation.labelled(ranked, labels, "candidate_id"), ["q"]).first()
    assert got.composite >= 0.85 and got.honeypot_10 <= 0.2 and got.ndcg_10 >= 0.6


def test_head_is_ordered_and_explained(spark, pools):
    rows, _ = pools["search", "full"]
    result = engine.rank(spark, synthetic.ROLES["search"].job, rows, top_n=20)
    head = result.collect()
    assert [r["rank"] for r in head] == list(range(1, 21))
    shown = [r["display_score"] for r in head]
    assert all(a > b for a, b in zip(shown, shown[1:]))
    assert all(40 <= len(r["reasoning"]) <= 500 for r in head) and result.notes
    packets = explain.packets(result.head)
    assert packets.count() == 20 and packets.first().evidence.title
    assert explain.interview_questions(packets, result.spec).count() > 20
    c = explain.compare(result.head, 1, 2).first()
    assert c.winner == head[0]["candidate_id"] and len(c.deltas) == 7
    ranked_pool = engine.ranking.top(result.pool, 90, engine.ranking.rank_order())
    report = explain.transparency(ranked_pool, head[0]["candidate_id"], result.spec).first()
    assert report.met and report["rank"] == 1
    rated = result.head.select("rank", "risk_flags", explain.decision().alias("d"), explain.fit_label().alias("f"), explain.hidden_fit()).collect()
    assert len(rated) == 20 and all(r.d.decision == ("investigate" if r.d.concerns and r["rank"] <= 10 or r.risk_flags else "keep") for r in rated)
    spine = engine.ranking.top(engine.score_pool(rows, result.spec), 90, engine.ranking.rank_order())
    assert 0 < explain.traps(spine).count() <= 5


def test_veto_keeps_rows(spark, pools):
    rows, _ = pools["search", "full"]
    scored = engine.score_pool(rows, engine.resolve_job(synthetic.ROLES["search"].job))
    assert scored.count() == 90
    pots = scored.where(F.col("candidate_id").contains("honeypot")).collect()
    assert len(pots) == 10 and all(r.final_score == 0 and r.vetoed for r in pots)


def test_vectors_help_paraphrases(spark, pools):
    rows, _ = pools["search", "full"]
    spec = engine.resolve_job(synthetic.ROLES["search"].job)

    def embedder(texts):
        words = ("best", "closest", "profiles", "retrieval", "ranking", "order")
        return [[1.0 if any(w in t.lower() for w in words) else 0.0, 0.1] for t in texts]

    mean = lambda df: df.where(F.col("candidate_id").contains("paraphrase")).agg(F.avg("final_score").alias("m")).first().m
    assert mean(engine.score_pool(rows, spec, "hybrid", embedder=embedder)) > mean(engine.score_pool(rows, spec, "hybrid"))
    index = engine.embed_column(features(rows), "match_text", embedder).select("candidate_id", "vec").where("candidate_id like '%para%'")
    scored = engine.score_pool(rows, spec, "hybrid", index=index, embedded=embedder([r.text for r in spec.requirements]))
    assert scored.count() == 90 and mean(scored) > mean(engine.score_pool(rows, spec, "hybrid"))


def test_many_jobs_and_cache(spark, pools):
    rows, _ = pools["search", "full"]
    jobs = {n: synthetic.ROLES[n].job for n in ("search", "sales")}
    many = engine.rank_many(spark, jobs, rows, top_n=10)
    assert many.groupBy("job_id").count().collect() and many.count() == 20
    cache = engine.Cache(spark)
    assert cache.rank(jobs["search"], rows, top_n=5) is cache.rank(jobs["search"], rows, top_n=5)
    assert engine.pool_fingerprint(rows) == engine.pool_fingerprint(rows.orderBy(F.rand(3)))
    assert engine.pool_fingerprint(rows) != engine.pool_fingerprint(rows.limit(3))
    cache.invalidate()


def own_job(spec, title, *must):
    wanted = tuple(requirements.Requirement(t, lexicons.MUST, 1.0, tuple(t.split())) for t in must)
    return dataclasses.replace(spec, id=title, title=title, category="craft", requirements=wanted)


def test_many_jobs_equal_one_by_one(spark, pools):
    """Heads of the job table equal those of each job alone, filled up with rows that share no word with the job."""
    rows = pools["search", "full"][0].limit(40)
    jobs = {n: engine.resolve_job(r.job, category=c) for (n, r), c in zip(synthetic.ROLES.items(), ("ai_ml_search_ranking", "other"))}
    jobs["strange"] = own_job(jobs["search"], "Glassblower", "furnace blowing", "annealing glass")
    jobs["empty"] = own_job(jobs["search"], "Anything")
    got = {}
    for r in engine.rank_many(spark, jobs, rows, top_n=15).collect():
        got.setdefault(r.job_id, []).append((r["rank"], r.candidate_id, r.final_score))
    for name, spec in jobs.items():
        head = ranking.top(engine.score_pool(rows, spec), 15, ranking.rank_order()).select("rank", "candidate_id", "final_score").collect()
        assert sorted(got[name]) == sorted((r["rank"], r.candidate_id, r.final_score) for r in head)


def test_many_jobs_are_one_plan(spark, pools):
    """As many plan nodes for a thousand jobs as for two, and one scan for the pairs."""
    rows = pools["search", "full"][0]
    spec = engine.resolve_job(synthetic.ROLES["search"].job)
    nodes = set()
    for n in (2, 1000):
        plan = engine.rank_many(spark, {f"j{i}": own_job(spec, f"Role {i}", f"skill{i} python", "retrieval") for i in range(n)}, rows, top_n=5)._jdf.queryExecution().optimizedPlan()
        nodes.add(plan.collectLeaves().size() * 1000 + len([x for x in plan.treeString().split("\n") if x.strip()]))
    assert len(nodes) == 1


def test_cache_tells_indexes_apart(spark, pools):
    """Two indexes of one schema give two heads; equal rows in another order give one."""
    rows = pools["search", "full"][0]
    spec = engine.resolve_job(synthetic.ROLES["search"].job)
    embedded = [[1.0, 0.0] for _ in spec.requirements]
    vectors = lambda near: rows.select("candidate_id", F.when(F.col("candidate_id").rlike(near), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vec"))
    cache = engine.Cache(spark)
    heads = [cache.rank(spec, rows, top_n=5, index=vectors(near), embedded=embedded) for near in ("[02468]$", "[13579]$", "[02468]$")]
    assert heads[0] is heads[2] and heads[0] is not heads[1]
    assert heads[0].collect() != heads[1].collect()
    assert cache.rank(spec, rows, top_n=5, index=vectors("[02468]$").orderBy(F.rand(1)), embedded=embedded) is heads[0]
    with pytest.raises(TypeError):
        cache.rank(spec, rows, top_n=object())
    cache.invalidate()


def test_appended_rows_alone_are_scored(spark, pools, monkeypatch):
    """The head after an append equals that of the whole pool, which is then kept under the pool's content."""
    rows = pools["search", "full"][0]
    old, new = rows.where(F.xxhash64("candidate_id") % 3 != 0), rows.where(F.xxhash64("candidate_id") % 3 == 0)
    job = synthetic.ROLES["search"].job
    cache, scored = engine.Cache(spark), []
    score = engine.score_pool
    monkeypatch.setattr(engine, "score_pool", lambda candidates, *a, **k: scored.append(candidates.count()) or score(candidates, *a, **k))
    cache.rank(job, old, top_n=12)
    head = cache.append(job, old, new, top_n=12)
    assert scored == [old.count(), new.count()] and 0 < scored[1] < scored[0]
    shown = ["rank", "candidate_id", "display_score", "reasoning", "risk_flags"]
    assert head.select(shown).orderBy("rank").collect() == engine.rank(spark, job, rows, top_n=12).head.select(shown).orderBy("rank").collect()
    assert cache.rank(job, rows, top_n=12) is head
    assert cache.append(job, rows.limit(3), new.limit(2), top_n=5).count() == 5  # nothing kept of that pool
    cache.invalidate()


def test_failing_second_score_becomes_a_note(spark, pools):
    def broken(head):
        raise RuntimeError("no model")

    result = engine.rank(spark, synthetic.ROLES["search"].job, pools["search", "full"][0], top_n=5, second_score=broken)
    assert len(result.collect()) == 5 and any("RuntimeError" in n for n in result.notes)
    swapped = engine.rank(spark, synthetic.ROLES["search"].job, pools["search", "full"][0], top_n=5,
                          second_score=lambda h: h.withColumn("second", F.col("rank").cast("double")), rerank_k=5)
    assert sorted(r["rank"] for r in swapped.collect()) == [1, 2, 3, 4, 5]


def test_attacks_and_invariance(spark, pools):
    rows, labels = pools["search", "full"]
    weak = rows.join(labels.where("archetype = 'weak'").select("candidate_id").limit(5), "candidate_id", "left_semi").cache()
    spec = engine.resolve_job(synthetic.ROLES["search"].job)
    score = lambda df: engine.score_pool(df, spec)
    rates = {r.attack: r for r in adversarial.resistance(weak, spec, score).collect()}
    assert set(rates) == {*adversarial.ATTACKS, None}
    assert rates["skill_stuffing"].resistance == 1.0 and rates["fabricated_experience"].resistance == 1.0
    assert all(r.largest < 1e-9 for r in adversarial.name_changes(weak, score).collect())
    moved = adversarial.location_effect(weak, [("Pune", "India"), ("Oslo", "Norway")], score)
    assert all(r.spread > 0 for r in moved.collect())


def test_profile_and_archetypes(spark, pools):
    rows = features(pools["search", "full"][0])
    assert profiling.most_common(rows, "title", 3).count() == 3
    assert profiling.sample_per_label(rows, profiling.archetypes(), "candidate_id", 2).groupBy("label").count().agg(F.max("count")).first()[0] <= 2


def test_signal_registry(spark, pools):
    rows = audits.audited(features(pools["search", "full"][0])).withColumn("schema_signals", signals.schema_signals())
    signals.register(signals.Signal("broken", 1.0, lambda: F.lit(float("nan"))))
    try:
        got = signals.blend(rows).select("blended", "signal_broken").collect()
    finally:
        del signals.REGISTRY["broken"]
    assert all(0 <= r.blended <= 1 and r.signal_broken == 0 for r in got)


def test_sinks(spark, pools, tmp_path):
    result = engine.rank_to_csv(spark, synthetic.ROLES["search"].job, pools["search", "full"][0], str(tmp_path / "ranking"), top_n=12)
    back = spark.read.csv(str(tmp_path / "ranking"), header=True).collect()
    assert len(back) == 12 and [int(r["rank"]) for r in back] == list(range(1, 13)) and back[0].score.count(".") == 1
    again = engine.rank_to_csv(spark, synthetic.ROLES["search"].job, pools["search", "full"][0], str(tmp_path / "again"), top_n=12)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "again"), header=True).collect()] == [tuple(r) for r in back] and again
    for write in (sinks.write_factor_scores, sinks.write_risk_report, sinks.write_risk_summary):
        write(result.head, str(tmp_path / write.__name__))
    summary = json.loads(spark.read.text(str(tmp_path / "write_risk_summary")).first().value)
    assert summary["rows"] == 12
    sinks.write_packets(explain.packets(result.head), str(tmp_path / "packets"))
    assert spark.read.json(str(tmp_path / "packets")).count() == 12
    sinks.write_workbook([("a", "b & <c>"), (1, None)], str(tmp_path / "book.xlsx"))
    assert (tmp_path / "book.xlsx").stat().st_size > 500
    lines = readers.lines_of(spark, ["{}"])
    labels = pools["search", "full"][1]
    sinks.write_pool(lines, labels, "a job", str(tmp_path / "pool"))
    assert spark.read.parquet(str(tmp_path / "pool" / "labels")).count() == 90
    ledger = result.head.select("candidate_id", "rank").withColumn("keyword_rank", F.lit(200))
    sinks.write_rescue_ledger(ledger, str(tmp_path / "rescue"), 100)
    assert json.loads(spark.read.text(str(tmp_path / "rescue" / "summary")).first().value)["rescued"] == 12
    assert sinks.markdown_table(result.head.select("rank")).count("\n") == 14


def test_reports(spark, pools):
    rows = pools["search", "full"][0]
    profile = {(r.section, r.name): r.value for r in reports.dataset_profile(features(rows)).collect()}
    assert profile["size", "rows"] == "90" and profile["size", "repeated ids"] == "0"
    assert {"years p10", "years p50", "years p90"} <= {n for s, n in profile if s == "percentiles"}
    jobs = {n: synthetic.ROLES[n].job for n in ("search", "sales")}
    review = reports.multi_job_review(spark, jobs, rows, top_n=10)
    assert review["overlap"].count() == 1 and review["titles"].groupBy("job_id").count().count() == 2
    assert review["flags"].columns == ["job_id", "flag", "n"]
    text = reports.as_markdown("Review", {"Overlap": review["overlap"], "Titles": review["titles"]})
    assert text.startswith("# Review") and "## Titles" in text


def test_counted_keywords(spark):
    df = spark.createDataFrame([("ML html and search, search",)], "t string")
    assert df.select(explain.occurrences(df.t).alias("n")).first().n == 4
