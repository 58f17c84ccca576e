"""Queries of the training-data operators for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meritlens.llm import bpe, chat, fingerprints, langid, media, minhash, packing, quality, repair, simhash, toxicity, urls, whitening
from meritlens.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2(spark, table(spark, sf_dir, "conversations"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op3(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op4(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.op5(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6(spark, table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op7(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op9(spark, table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(spark, table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(spark, table(spark, sf_dir, "embeddings"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op12(spark, table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op13(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_toxicity, op2_chat, op3_urls, op4_media, op5_byte_bpe, op6_simhash, op7_quality, op8_packing,
        op9_fingerprints, op10_language, op11_whitening, op12_repair, op13_minhash,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op12_repair": repair.SQL}
