"""Costly values are worked out once a row, and a pool once a head."""

import os

from meritlens.operators import audits, requirements
from meritlens.plans import record_queries
from meritlens.sources.schema import CANDIDATE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_record_text_is_not_cleaned_for_each_word_of_each_skill(spark):
    records = spark.createDataFrame([], CANDIDATE)
    rows = records.selectExpr("*", "1.0D AS years").withColumn("f", audits.consistency_flags())
    told = rows._jdf.queryExecution().analyzed().toString().lower()
    assert "exists(" in told and "contains(regexp_replace" not in told


def test_list_items_are_cut_once(spark):
    jobs = spark.createDataFrame([("a", "Must have Python, SQL and Spark.")], "job_id string, text string")
    found = requirements.parse_table(jobs)
    assert found._jdf.queryExecution().analyzed().toString().count(requirements.LIST_SEPARATOR) == 1
    assert [r.text for r in found.orderBy("req_idx").collect()] == ["Python", "SQL", "Spark"]


def test_audit_of_a_head_takes_up_the_kept_head(spark):
    plan = record_queries.q58(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
