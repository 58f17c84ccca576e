"""Corpus preparation over ``documents``: toxicity, quality, near-duplicates, packing.

Each stage reads what its predecessor kept; what a stage rejects is gone for all later ones.  The
first three return the columns of ``documents``, the last returns packed pieces.

All stages take whole texts of any length, count null text as empty, judge repeated rows alike, carry
further columns along whatever their names (the last ignores them), and return an empty table for one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meritlens.llm import packing, quality, similar, toxicity
from meritlens.llm.common import bound_batches, discard, materialize, ship_package, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject, repeated rows as often as they occur.

    Empty texts have the base score; a score at the threshold is rejected; without labels of both kinds
    all documents stay."""
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, repeated rows as often as they occur.

    Empty texts pool to the zero vector; a score at the threshold stays; without labels of both kinds the
    score is the share of good labels, and 0 without labels, so that no document stays."""
    return quality.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (similarity of 0.8 or more).

    Texts without words are one group; documents without a doc_id all stay; of different texts under one
    doc_id each is judged by itself; ties of doc_id go by the hash of the text."""
    bound_batches(spark)
    ship_package(spark)
    return similar.one_per_group(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, in the order of the scan.

    An empty text is its separator alone; documents without a doc_id are packed too."""
    bound_batches(spark)
    ship_package(spark)
    return packing.pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_copies),
    ("packing", pack),
]

#: No stage but the last could be written in SQL, and the last needs the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written as Parquet and read again, and deleted once the next has it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
