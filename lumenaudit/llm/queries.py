"""The operators as queries: each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontam, licenses, linewindows, mixing, mtree, negatives, quality, simhash, substring, tokenids, toxicity, warc
from .common import documents, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op3(documents(spark, sf_dir))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.op4(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op6(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op8(documents(spark, sf_dir))


def op9_linewindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linewindows.op9(documents(spark, sf_dir))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op10(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11(table(spark, sf_dir, "conversations"))


def op12_tokenids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where vocabularies are on this machine; the operator takes any file

    return tokenids.op12(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.op13(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
