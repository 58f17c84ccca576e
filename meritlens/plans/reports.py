"""Reports over pools and rankings, as DataFrames and as Markdown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.operators import profiling, ranking
from meritlens.plans import engine
from meritlens.sources.sinks import markdown_table

PROFILED = {"years": "years", "response rate": "response_rate", "months since active": "last_active_months"}


def dataset_profile(rows: DataFrame, common: int = 10) -> DataFrame:
    """(section, name, value) of feature rows: sizes, common values, percentiles."""
    text = lambda df, section, name, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    repeated = rows.groupBy("candidate_id").count().where("count > 1").agg(F.count("*").alias("n"))
    out = text(rows.agg(F.count("*").alias("n")), "size", F.lit("rows"), F.col("n"))
    out = out.unionByName(text(repeated, "size", F.lit("repeated ids"), F.col("n")))
    for column in ("title", "country", "current_industry"):
        top = profiling.most_common(rows, column, common)
        out = out.unionByName(text(top, f"common {column}", F.col(column), F.col("n")))
    skills = profiling.most_common(rows.select(F.explode("skill_names").alias("skill")), "skill", common)
    out = out.unionByName(text(skills, "common skill", F.col("skill"), F.col("n")))
    for name, column in PROFILED.items():
        cut = profiling.nearest_rank(rows, column, (0.1, 0.5, 0.9))
        label = F.concat(F.lit(f"{name} p"), F.round(F.col("share") * 100).cast("int").cast("string"))
        out = out.unionByName(text(cut, "percentiles", label, F.col("value")))
        ends = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))
        out = out.unionByName(text(ends, "ends", F.lit(name), F.concat_ws(" to ", F.col("low").cast("string"), F.col("high").cast("string"))))
    return out


def multi_job_review(spark: SparkSession, jobs: Mapping[str, str], candidates: DataFrame, top_n: int = 25, common: int = 5) -> dict[str, DataFrame]:
    """Heads of several jobs with their common titles, their flags and how far they overlap."""
    heads = engine.rank_many(spark, jobs, candidates, top_n=top_n).cache()  # at most top_n rows a job
    counts = heads.groupBy("job_id", "title").agg(F.count("*").alias("n"))
    order = Window.partitionBy("job_id").orderBy(F.col("n").desc(), "title")
    titles = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= common)
    flags = heads.select("job_id", F.explode("risk_flags").alias("flag")).groupBy("job_id", "flag").agg(F.count("*").alias("n"))
    return {"heads": heads, "titles": titles, "flags": flags, "overlap": ranking.overlap(heads, "job_id", "candidate_id")}


def as_markdown(title: str, parts: Mapping[str, DataFrame], most: int = 100) -> str:
    """A report of several tables."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df, most)}" for name, df in parts.items())
