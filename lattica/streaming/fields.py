"""Fields of unbounded particle streams. A field is a sum by cell, so it is a streaming aggregation as it stands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.raster import render_points_volume


def stream_volume(particles: DataFrame, pixels_per_unit: float, grid_size: int | Sequence[int], periodic=False, subsample_factor: int = 4) -> DataFrame:
    """particles: a streaming frame (x, y, z, weight, radius). State: one sum a cell, at most the grid."""
    if not particles.isStreaming:
        raise ValueError("a streaming frame is needed")
    return render_points_volume(particles, pixels_per_unit, grid_size, periodic, subsample_factor)


def start_volume(field: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return field.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
