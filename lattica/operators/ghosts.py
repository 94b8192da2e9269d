"""Periodic images of spheres that cross a face of the box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_ghosts(vertices: DataFrame, sides: Sequence[float]) -> DataFrame:
    """Each sphere and its images, axis by axis, so that edges and corners get theirs; a side <= 0: no images there."""
    out = vertices
    for axis, side in zip(("x", "y", "z"), sides, strict=True):
        if side > 0:
            c, r, box = F.col(axis), F.col("radius"), F.lit(float(side))
            images = F.array(c, F.when(c + r > box, c - box), F.when(c - r < 0, c + box))
            out = out.withColumn(axis, F.explode(F.filter(images, lambda v: v.isNotNull())))
    return out
