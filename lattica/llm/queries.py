"""One query for each operation, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, exact_dedup, fm_dedup, jaccard_join, lm_score, pii, quality, sentencepiece_codec, sharding, suffix_dedup
from lattica.llm.sql import ORACLES

SHARDS = 24


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_lm_score(spark: SparkSession, d: str) -> DataFrame:
    return lm_score.score(read(spark, d, "documents"))


def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return fm_dedup.fm_dedup(read(spark, d, "documents"))


def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(read(spark, d, "documents"))


def op4_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return sentencepiece_codec.encode_and_check(read(spark, d, "documents"))


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, d, "documents"))


def op6_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, d, "documents"))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return quality.score(docs, quality.train(docs, read(spark, d, "labels")))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.assign_shards(read(spark, d, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, d, "documents"))


def op10_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(read(spark, d, "documents"), read(spark, d, "benchmark"))


def table() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_substring_dedup, op3_pii, op4_sentencepiece, op5_jaccard_join, op6_suffix_dedup, op7_quality, op8_sharding, op9_exact_dedup, op10_decontamination)}


def oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in table()}
