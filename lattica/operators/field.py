"""Measures of particles and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.display import log1p, to_byte


def particle_metrics(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.count("*").alias("n"), F.max("radius").alias("max_radius"), F.round(F.avg("radius"), 9).alias("mean_radius"), F.round(F.sum("weight"), 6).alias("mass"))


def field_metrics(field: DataFrame, n_cells: int) -> DataFrame:
    """Total, number and share of cells with mass."""
    return field.agg(F.round(F.sum("value"), 6).alias("total"), F.count_if(F.col("value") > 0).alias("occupied"), (F.count_if(F.col("value") > 0) / F.lit(float(n_cells))).alias("occupancy"))


def mass_ratio(field: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rendered mass, given mass and their ratio (one row each, so the join is of two single rows)."""
    return field.agg(F.sum("value").alias("rendered")).join(vertices.agg(F.sum("weight").alias("mass"))).select(F.round("rendered", 6).alias("rendered"), F.round("mass", 6).alias("mass"), F.round(F.col("rendered") / F.col("mass"), 6).alias("ratio"))


def slice_of(field: DataFrame, iz: int) -> DataFrame:
    return field.filter(F.col("iz") == iz).select("ix", "iy", "value")


def front_slices(field: DataFrame, n: int) -> DataFrame:
    return field.filter(F.col("iz") < n)


def voxel(field: DataFrame, at: tuple[int, int, int]) -> DataFrame:
    return field.filter((F.col("ix") == at[0]) & (F.col("iy") == at[1]) & (F.col("iz") == at[2]))


def slice_range(field2d: DataFrame) -> DataFrame:
    return field2d.agg(F.min("value").alias("low"), F.max("value").alias("high"))


def slice_bytes(field2d: DataFrame) -> DataFrame:
    """Pixels rescaled to 0..255 by the slice's own range."""
    return field2d.join(F.broadcast(slice_range(field2d))).select("ix", "iy", to_byte(F.col("value"), F.col("low"), F.col("high")).alias("pixel"))


def slice_log1p(field2d: DataFrame) -> DataFrame:
    return field2d.select("ix", "iy", F.round(log1p(F.col("value")), 9).alias("value"))
