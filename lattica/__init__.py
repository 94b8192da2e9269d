"""lattica: spatial analytics on weighted 3-D point clouds, planned as Spark DataFrames."""

from lattica.functions.metrics import L2, PeriodicL2
from lattica.operators.index import SpatialIndex
from lattica.operators.knn import knn_join, knn_lookup
from lattica.operators.raster import render_points, render_points_volume

__all__ = ["L2", "PeriodicL2", "SpatialIndex", "knn_join", "knn_lookup", "render_points", "render_points_volume"]
