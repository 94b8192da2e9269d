"""Column functions for showing a field."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def log1p(value: Column) -> Column:
    return F.log1p(value)


def to_byte(value: Column, low: Column, high: Column) -> Column:
    """Min-max rescale to 0..255, truncating; a constant field is 0."""
    return F.when(high > low, ((value - low) / (high - low) * F.lit(255.0)).cast("int")).otherwise(F.lit(0))


def median_of_3(a: Column, b: Column, c: Column) -> Column:
    return F.array_sort(F.array(a, b, c))[1]
