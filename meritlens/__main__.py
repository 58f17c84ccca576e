"""Command line: ``rank`` a file of candidates for a job into a CSV, ``index`` their vectors.

    python -m meritlens rank JOB CANDIDATES OUT [--top 100] [--engine spine|hybrid] [--embedder module:function]
    python -m meritlens index CANDIDATES OUT --embedder module:function

An embedder takes a list of texts and returns a vector for each.  The session is Spark's default one, so
that ``spark-submit`` and its settings apply.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from meritlens.operators.features import features
from meritlens.plans import engine
from meritlens.sources import readers, sinks


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="meritlens")
    commands = parser.add_subparsers(dest="command", required=True)
    rank = commands.add_parser("rank", help="rank candidates for a job")
    rank.add_argument("job", help="a scorecard (.yaml), a description (.md, .txt) or its text")
    rank.add_argument("candidates", help="JSON lines, also gzipped")
    rank.add_argument("out", help="CSV of candidate_id, rank, score and reasoning")
    rank.add_argument("--top", type=int, default=100)
    rank.add_argument("--engine", choices=("spine", "hybrid"), default="spine")
    rank.add_argument("--category", default="ai_ml_search_ranking")
    rank.add_argument("--embedder", type=_named, help="module:function")
    index = commands.add_parser("index", help="write candidates' vectors")
    index.add_argument("candidates")
    index.add_argument("out")
    index.add_argument("--embedder", type=_named, required=True, help="module:function")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("meritlens").getOrCreate()
    if given.command == "rank":
        rows = readers.read_candidates(spark, given.candidates)
        parts = f"{given.out}.parts"
        engine.rank_to_csv(spark, given.job, rows, parts, top_n=given.top, engine=given.engine, category=given.category, embedder=given.embedder)
        sinks.as_file(spark, parts, given.out)
    else:
        rows = features(readers.read_candidates(spark, given.candidates))
        vectors = engine.embed_column(rows.select("candidate_id", "match_text"), "match_text", given.embedder)
        sinks.write_index(vectors.select("candidate_id", "vec"), given.out)


if __name__ == "__main__":
    main()
