"""Points and particles from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 2.0
PPU = 8.0


def emb_points(spark: SparkSession, d: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") + F.lit(1.0) for i in range(3)]
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), e[0].alias("x"), e[1].alias("y"), e[2].alias("z"))


def emb_particles(spark: SparkSession, d: str) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") + F.lit(1.0) for i in range(3)]
    label = F.col("label").cast("double")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        e[0].alias("x"), e[1].alias("y"), e[2].alias("z"), (label + 1.0).alias("weight"), ((label * 0.125 + 0.75) / 8.0).alias("radius")
    )


def line_particles(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_quantity").cast("double") / 50.0).alias("x"), (F.col("l_discount").cast("double") * 10.0).alias("y"), (F.col("l_tax").cast("double") * 12.5).alias("z"),
        F.col("l_extendedprice").cast("double").alias("weight"), F.lit(0.001).alias("radius"),
    )


def tie_points(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (quantity, discount, tax); ids are made from the values, so no global numbering is needed."""
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_tax").cast("double").alias("z")).distinct()
    return t.select((F.round(F.col("x")) * 10000 + F.round(F.col("y") * 100) * 100 + F.round(F.col("z") * 100)).cast("long").alias("id"), "x", "y", "z")
