"""Last digits: sums and rounding must not hang on partitions, shuffles or the order of a map."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from meritlens.functions import scalars as sc
from meritlens.operators import matching, signals
from meritlens.plans import driver_queries


def test_requirement_sums_go_by_requirement(spark):
    kinds = ["must_have"] * 3 + ["nice_to_have"] * 2
    table = spark.createDataFrame([("j", i, k, 1.0 if i < 3 else 0.4) for i, k in enumerate(kinds)], "job_id string, req_idx long, kind string, weight double")
    scores = [0.1, 0.7, 0.2, 0.3, 0.6]
    for seed in range(3):
        rows = [(d, "j", i, k, 1.0 if i < 3 else 0.4, scores[(i + d) % 5]) for d in range(40) for i, k in enumerate(kinds)]
        random.Random(seed).shuffle(rows)
        pairs = spark.createDataFrame(rows, "doc_id long, job_id string, req_idx long, kind string, weight double, lexical double").repartition(7, "req_idx")
        got = matching.aggregate_table(pairs, table, "doc_id", spark.range(41).withColumnRenamed("id", "doc_id"), digits=None)
        for r in got.collect():
            own = [scores[(i + r.doc_id) % 5] if r.doc_id < 40 else 0.0 for i in range(5)]
            must, nice = 0.0 + own[0] + own[1] + own[2], 0.0 + 0.4 * own[3] + 0.4 * own[4]
            assert r.semantic_fit == min(1.0, 0.85 * (must / 3.0) + 0.15 * (nice / 0.8))
            assert r.lexical_fit == (0.0 + own[0] + own[1] + own[2] + 0.4 * own[3] + 0.4 * own[4]) / (3.0 + 0.4 + 0.4)


@pytest.mark.parametrize("name", ["q22_schema_signals", "q23_hireability", "q40_blended_signals"])
def test_event_means_over_many_files(spark, tmp_path, name):
    rng, kinds = random.Random(5), ("click", "purchase", "view", "signup", "error")
    rows = [(i, rng.randrange(150), rng.choice(kinds), round(rng.random() * 120, 2), f'{{"k": {rng.randrange(101)}}}') for i in range(24000)]
    table = pa.table(dict(zip(("event_id", "user_id", "event_type", "value", "props"), map(list, zip(*rows)))))
    (tmp_path / "many" / "events.parquet").mkdir(parents=True)
    pq.write_table(table, tmp_path / "events.parquet")
    for k in range(12):
        pq.write_table(table.slice(2000 * k, 2000), tmp_path / "many" / "events.parquet" / f"{k:02}.parquet")
    db = duckdb.connect()
    db.sql("set threads = 1")
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    query = db.sql(driver_queries.SQL[name])
    held = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)
    try:
        got = driver_queries.QUERIES[name](spark, str(tmp_path / "many")).select(*query.columns).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", held)
    assert sorted(map(tuple, got)) == sorted(query.fetchall())


def test_signal_means_do_not_hang_on_the_order_of_a_map(spark):
    told = {"avg_response_time_hours": "114", "saved_by_recruiters_30d": "8", "search_appearance_30d": "127", "interview_completion_rate": "0.75"}
    orders = [list(told.items())] + [random.Random(k).sample(list(told.items()), 4) for k in range(20)]
    rows = [F.create_map(*(F.lit(x) for kv in o for x in kv)) for o in orders]
    got = spark.range(1).select(*(signals.schema_signals(m).alias(f"m{k}") for k, m in enumerate(rows))).first()
    assert len({tuple(r) for r in got}) == 1 and got[0].engagement == 0.6638


def test_blend_adds_up_as_registered(spark):
    rows = spark.createDataFrame([(0.4551, 0.8, 34.0, False)], "hire double, audit_penalty double, github_activity_score double, impossible boolean")
    rows = rows.withColumn("schema_signals", F.struct(*(F.col("hire").alias(c) for c in ("availability", "engagement", "trust"))))
    r = signals.blend(rows).first()
    assert r.blended == (0.0 + r.signal_hireability + (1.0 - 0.8) + 0.5 * 0.34) / 2.5
    assert [c for c in r.asDict() if c.startswith("signal_")][:3] == ["signal_hireability", "signal_consistency", "signal_account_activity"]


def test_rounding_goes_by_the_scaled_value(spark):
    values = [0.60125, 0.40495, 0.00625, 0.255495, 1.00495, 0.0, 0.33335]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sc.rounded(F.col("v"), 4).alias("r")).orderBy("i").collect()
    want = duckdb.sql("select " + ", ".join(f"round({v}::double, 4)" for v in values)).fetchall()[0]
    assert tuple(r.r for r in got) == want
