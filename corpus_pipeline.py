"""A corpus pipeline: each stage works on what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_codec
from lattica.llm.shared import cleaned, discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is judged as an empty one; rows are judged each by its own text,
    whatever the id. Without labels nothing goes."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays; null counts as empty, a null id loses to any other, and of rows alike
    in both one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles, the one with the smallest id stays. Texts without words and rows without an id stay;
    rows that share an id are judged each by its own text."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go, each row by its own text; null texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether decoding them gives the text again; a null text has no tokens."""
    return sentencepiece_codec.encode_and_check(docs, keep_ids=True)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("sentencepiece", tokens_stage)]

#: The classifier and the tokenizer can't be told in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole table. An empty table gives no rows. What a stage has written besides its result, and
    the result of the one before, are deleted once its own is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        made: list[DataFrame] = []
        with cleaned(made):
            made.append(written(stage(spark, docs, sf_dir)))
            out = made[0]
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
