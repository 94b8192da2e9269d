"""Deposits weighted spheres on a grid. Fields are sparse: (ix, iy[, iz], value), cells without mass are absent.

Particles are expanded to the slices, then rows, then pixels they reach by ``explode(sequence(...))``: narrow steps with
no join, each filtered at once. One aggregation by cell, with partial sums before its shuffle, adds them up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.extents import extent, period
from lattica.operators.ghosts import add_ghosts


def _reach(center: Column, half: Column, size: int) -> Column:
    """Indices i in [0, size) with |i + 0.5 - center| <= half, as an array (empty if none)."""
    first = F.greatest(F.ceil(center - half - 0.5), F.lit(0)).cast("int")
    last = F.least(F.floor(center + half - 0.5), F.lit(size - 1)).cast("int")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _overlap(px: Column, py: Column, pz: Column, r2: Column, s: int) -> Column:
    """How many of the s**3 sample points of a cell lie inside the sphere; (px, py, pz): the center from the cell's corner.

    Squares are computed once an axis, then summed in nested array functions.
    """
    offs = [(i + 0.5) / s for i in range(s)]
    dx = [(px - o) * (px - o) for o in offs]
    dy = [(py - o) * (py - o) for o in offs]
    dz = [(pz - o) * (pz - o) for o in offs]
    axes = F.struct(F.array(*dx).alias("x"), F.array(*dy).alias("y"), F.array(*dz).alias("z"), r2.alias("r"))

    def count(a: Column) -> Column:
        return F.aggregate(
            a["x"], F.lit(0),
            lambda n, x: n + F.aggregate(a["y"], F.lit(0), lambda m, y: m + F.size(F.filter(a["z"], lambda z: x + y + z < a["r"]))),
        )

    return F.transform(F.array(axes), count)[0]


def _pixels(vertices: DataFrame, ppu: float, grid: Sequence[int]) -> DataFrame:
    return vertices.select((F.col("x") * ppu).alias("X"), (F.col("y") * ppu).alias("Y"), (F.col("z") * ppu).alias("Z"), F.col("weight").alias("w"), (F.col("radius") * ppu).alias("R"))


def _big(slices: DataFrame, grid: Sequence[int], s: int, footprint: str, keys: Sequence[str]) -> DataFrame:
    """slices: X, Y, w, R and zo, the offset of the center from the middle of its slice."""
    zo, r = F.col("zo"), F.col("R")
    if footprint == "reference":
        half = F.ceil(F.sqrt(F.greatest(F.lit(0.0), r * r - zo * zo))) + 1
    elif footprint == "full":
        half = F.ceil(r) + 1
    else:
        raise ValueError(f"unknown footprint {footprint!r}")
    cells = (
        slices.filter(r - F.abs(zo) + 1 >= 0)
        .withColumn("half", half)
        .withColumn("ix", F.explode(_reach(F.col("X"), F.col("half"), grid[0])))
        .withColumn("iy", F.explode(_reach(F.col("Y"), F.col("half"), grid[1])))
    )
    # no sample point of a cell is nearer than its box: most corner cells of the footprint go before they are counted
    near = None
    for c, i in (("X", "ix"), ("Y", "iy")):
        d = F.greatest(F.col(i) - F.col(c), F.lit(0.0)) + F.greatest(F.col(c) - F.col(i) - 1, F.lit(0.0))
        near = d * d if near is None else near + d * d
    n = _overlap(F.col("X") - F.col("ix"), F.col("Y") - F.col("iy"), zo + 0.5, r * r, s)
    value = F.col("w") / (F.lit(4.0 / 3.0 * math.pi) * r * r * r) * (F.col("n") / F.lit(float(s**3)))
    return cells.filter(near < r * r).withColumn("n", n).select(*keys, value.alias("value"), F.col("n").alias("hits"))


def _total(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums by cell. Cells without a sample point inside go here: a filter before the sums would be pushed below the count of
    sample points, which would then be made twice."""
    return cells.groupBy(*keys).agg(F.sum("value").alias("value"), F.max("hits").alias("hits")).filter("hits > 0").select(*keys, "value")


def _inside(c: str, size: int) -> Column:
    return (F.col(c) >= 0) & (F.col(c) < size)


def render_points_volume(vertices: DataFrame, pixels_per_unit: float, grid_size: int | Sequence[int], periodic: bool | float | Sequence[float] = False, subsample_factor: int = 4, footprint: str = "reference") -> DataFrame:
    """3-D field of vertices(x, y, z, weight, radius). Rows with a null column are left out; no rows give an empty field."""
    if subsample_factor < 1:
        raise ValueError("subsample_factor must be positive")
    gx, gy, gz = grid = extent(grid_size, 3)
    sides = period([g / pixels_per_unit for g in grid], periodic)
    px = _pixels(add_ghosts(vertices.dropna(subset=["x", "y", "z", "weight", "radius"]), sides), pixels_per_unit, grid)
    keys = ["ix", "iy", "iz"]
    small = (
        px.filter("R < 0.5")
        .select(F.floor("X").cast("int").alias("ix"), F.floor("Y").cast("int").alias("iy"), (F.ceil("Z") - 1).cast("int").alias("iz"), F.col("w").alias("value"), F.lit(1).alias("hits"))
        .filter(_inside("ix", gx) & _inside("iy", gy) & _inside("iz", gz))
    )
    slices = px.filter("R >= 0.5").withColumn("iz", F.explode(_reach(F.col("Z"), F.col("R") + 1, gz))).withColumn("zo", F.col("Z") - (F.col("iz") + 0.5))
    cells = small.unionByName(_big(slices, grid, subsample_factor, footprint, keys))
    return _total(cells, keys)


def render_points(vertices: DataFrame, pixels_per_unit: float, grid_size: int | Sequence[int], periodic: bool | float | Sequence[float] = False, footprint: str = "reference") -> DataFrame:
    """2-D field of the slice at depth 0. Spheres under half a pixel count if -0.5 < z <= 0.5, in units of position."""
    gx, gy = grid = extent(grid_size, 2)
    sides = period([gx / pixels_per_unit, gy / pixels_per_unit, -1.0], periodic)
    px = _pixels(add_ghosts(vertices.dropna(subset=["x", "y", "z", "weight", "radius"]), sides), pixels_per_unit, grid).withColumn("zo", F.col("Z"))
    keys = ["ix", "iy"]
    near = (F.col("R") - F.abs("zo") + 1 >= 0) & (F.col("Z") > -0.5 * pixels_per_unit) & (F.col("Z") <= 0.5 * pixels_per_unit)
    small = (
        px.filter("R < 0.5").filter(near)
        .select(F.floor("X").cast("int").alias("ix"), F.floor("Y").cast("int").alias("iy"), F.col("w").alias("value"), F.lit(1).alias("hits"))
        .filter(_inside("ix", gx) & _inside("iy", gy))
    )
    cells = small.unionByName(_big(px.filter("R >= 0.5"), grid, 4, footprint, keys))
    return _total(cells, keys)


class Renderer:
    """A grid and a subsample factor, to be used for several sets of vertices."""

    def __init__(self, grid_size: int | Sequence[int], subsample_factor: int = 4):
        self.grid, self.subsample_factor = extent(grid_size, 2), subsample_factor

    @property
    def width(self) -> int:
        return self.grid[0]

    @property
    def height(self) -> int:
        return self.grid[1]

    def volume(self, vertices: DataFrame, pixels_per_unit: float, num_slices: int, periodic=False) -> DataFrame:
        return render_points_volume(vertices, pixels_per_unit, (*self.grid, num_slices), periodic, self.subsample_factor)

    def slice(self, vertices: DataFrame, pixels_per_unit: float, periodic=False) -> DataFrame:
        return render_points(vertices, pixels_per_unit, self.grid, periodic)


def estimated_cells(vertices: DataFrame, pixels_per_unit: float) -> DataFrame:
    """About how many rows a render makes before its sums, to be looked at before a large one."""
    r = F.col("radius") * pixels_per_unit
    return vertices.agg(F.sum(F.when(r < 0.5, F.lit(1.0)).otherwise(8 * (r + 1) * (r + 1) * (r + 1))).alias("cells"))
