
from meritlens.operators import ranking, synthetic
from meritlens.plans import engine
from meritlens.sources.records import as_lines
from meritlens.streaming import rescoring


def test_stream_gives_the_batch_head(spark, tmp_path):
    role = synthetic.ROLES["search"]
    records = synthetic.records(role, {"strong": 4, "weak": 6, "honeypot": 2})
    folder = tmp_path / "in"
    folder.mkdir()
    spec = engine.resolve_job(role.job)
    for i, part in enumerate((records[:6], records[6:])):
        (folder / f"{i}.jsonl").write_text("\n".join(as_lines(part)))
        query = rescoring.rescore(rescoring.read_stream(spark, str(folder)), spec, 5, str(tmp_path / "head"), str(tmp_path / "state"))
        query.awaitTermination()
    head = spark.read.parquet(str(tmp_path / "head" / "batch=1")).orderBy("rank")
    pool, _ = synthetic.pool(spark, role, {"strong": 4, "weak": 6, "honeypot": 2})
    whole = ranking.top(engine.score_pool(pool, spec), 5, ranking.rank_order()).orderBy("rank")
    assert [r.candidate_id for r in head.collect()] == [r.candidate_id for r in whole.collect()]


def test_windowed_signals_in_batch(spark):
    rows = spark.sql("select timestamp_ntz'2025-01-01 01:00:00' ts, 'click' event_type, 2.0D value union all select timestamp_ntz'2025-01-01 09:00:00', 'click', 4.0D")
    got = rescoring.windowed_signals(rows).first()
    assert (got.n, got.mean_value) == (2, 3.0) and got.window.start.day == 1
