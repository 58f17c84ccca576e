"""Rescoring as candidate records arrive.

Scoring is a stateless map over the stream; only the head of the ranking has state, which each
micro-batch merges and rewrites.  The head is bounded by ``top_n``, so a batch never touches the pool.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from meritlens.operators import ranking
from meritlens.operators.requirements import Spec
from meritlens.plans.engine import score_pool
from meritlens.sources.schema import from_json_lines

KEPT = ("candidate_id", "final_score", "reach", "role_relevance", "general_quality", "risk_flags")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate rows of JSON-line files as they appear in a folder."""
    return from_json_lines(spark.readStream.text(folder))


def rescore(stream: DataFrame, spec: Spec, top_n: int, head_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the head of the ranking up to date under ``head_path`` (one folder for each batch).

    A candidate that arrives again replaces its earlier score; a batch that is run again after a
    failure rewrites its own folder from the one before, so the result is the same."""

    def merge(batch: DataFrame, number: int) -> None:
        scored = score_pool(batch, spec).select(*KEPT).withColumn("batch", F.lit(number))
        rows = scored
        if number > 0:
            before = batch.sparkSession.read.parquet(f"{head_path}/batch={number - 1}")
            rows = before.select(*KEPT).withColumn("batch", F.lit(number - 1)).unionByName(scored)
        latest = Window.partitionBy("candidate_id").orderBy(F.col("batch").desc(), F.col("final_score").desc())
        newest = rows.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n", "batch")
        ranking.top(newest, top_n, ranking.rank_order()).write.mode("overwrite").parquet(f"{head_path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_signals(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of each kind of event in tumbling windows, closed ``late`` after the newest event."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
