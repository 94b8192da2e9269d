"""Spatial index: points with a cell, and a table of cells with their bounding boxes.

Cells come in levels. The finest have about `leafsize` points, so their number grows with the points; a cell of the next level
holds up to 64 of them, and so on up to the first level of at most ``TOP_CELLS`` cells, which alone is broadcast.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.metrics import AXES, L2, metric_for
from lattica.sources.scratch import discard, written

#: Cells of the first level, which is broadcast; halvings of space from one level to the next (a third of them on each axis);
#: points of a cell up to which one task ranks them; accuracy of the quantiles that a larger cell's median is looked for between.
TOP_CELLS, HALVINGS, RANKED, ACCURACY = 512, 6, 50_000, 10_000


def domain_violations(df: DataFrame, box: float) -> DataFrame:
    """One row: how many positions lie outside [0, box] on some axis (NaN counts)."""
    inside = None
    for a in AXES:
        ok = (F.col(a) >= 0) & (F.col(a) <= float(box)) & ~F.isnan(a)
        inside = ok if inside is None else inside & ok
    return df.agg(F.count_if(~inside).alias("violations"), F.count("*").alias("n"))


def check_domain(points: DataFrame, metric: L2) -> None:
    """Points of a periodic box lie inside it."""
    if metric.periodic and domain_violations(points, metric.box).first()["violations"]:
        raise ValueError("with a periodic box, positions must lie in [0, boxsize]")


def assign_grid_cells(df: DataFrame, lo: tuple[float, ...], step: float, bins: int) -> DataFrame:
    cell = None
    for a, low in zip(AXES, lo, strict=True):
        i = F.least(F.greatest(F.floor((F.col(a) - low) / step), F.lit(0)), F.lit(bins - 1))
        cell = i if cell is None else cell * bins + i
    return df.withColumn("cell_id", cell.cast("long"))


def _medians(rows: DataFrame, axis: str) -> DataFrame:
    """(cell_id, _split): the exact lower median of each of these cells, few and large. Values between two approximate quantiles
    around it are counted one by one, those below as one; if it isn't among them, between quantiles farther apart."""
    c = F.col(axis)
    for wide in (2 / ACCURACY, 0.05, None):
        ends = F.percentile_approx(c, [0.5 - wide, 0.5 + wide], ACCURACY) if wide else F.array(F.min(c), F.max(c))
        bounds = rows.groupBy("cell_id").agg(F.count("*").alias("_n"), ends.alias("_ends"))
        inside = rows.join(F.broadcast(bounds), "cell_id").filter(c <= F.col("_ends")[1])
        counts = inside.groupBy("cell_id", "_n", F.when(c >= F.col("_ends")[0], c).alias("_v")).agg(F.count("*").alias("_m"))
        seen = F.sum("_m").over(Window.partitionBy("cell_id").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = counts.withColumn("_seen", seen).filter(F.col("_seen") >= F.ceil(F.col("_n") / 2)).groupBy("cell_id").agg(F.min_by("_v", "_seen").alias("_split"))
        found = written(bounds.select("cell_id").join(first, "cell_id", "left"))
        if not wide or not found.filter("_split IS NULL").limit(1).count():
            return found
        discard(found)


def assign_median_cells(df: DataFrame, depth: int, ranked: int = RANKED) -> DataFrame:
    """Balanced splits at exact lower medians, axes in turn. Cells of more than `ranked` points are split by all tasks together, a
    level a round, and written; the levels below are windows within the task of such a cell. The result is written too, so
    neither plan nor work grows with its readers."""
    out = df.withColumn("cell_id", F.lit(1).cast("long"))

    def halved(split: Column, axis: str) -> Column:
        return F.col("cell_id") * 2 + (F.col(axis) > split).cast("long")

    for d in range(depth):
        large = written(out.groupBy("cell_id").count().filter(F.col("count") > ranked).select("cell_id"))
        if not large.limit(1).count():
            discard(large)
            break
        axis = AXES[d % 3]
        splits = _medians(out.join(F.broadcast(large), "cell_id"), axis)
        after = written(out.join(F.broadcast(splits), "cell_id", "left").select(*df.columns, F.coalesce(halved(F.col("_split"), axis), "cell_id").alias("cell_id")))
        discard(out, large, splits)
        out = after
    whole, least = out, out.agg(F.min("cell_id")).first()[0] or 1
    out = out.withColumn("_part", F.col("cell_id")).repartition("_part")
    for d in range(least.bit_length() - 1, depth):
        axis, cell = AXES[d % 3], Window.partitionBy("_part", "cell_id")
        # the first of two tiles has the odd row, so it ends with the lower median
        tiled = out.withColumn("_tile", F.ntile(2).over(cell.orderBy(axis)))
        out = tiled.withColumn("_split", F.max(F.when(F.col("_tile") == 1, F.col(axis))).over(cell)).select(
            *df.columns, F.when(F.col("cell_id") < 2 << d, halved(F.col("_split"), axis)).otherwise(F.col("cell_id")).alias("cell_id"), "_part"
        )
    out = written(out.drop("_part"))
    discard(whole)
    return out


def cell_table(celled: DataFrame) -> DataFrame:
    return celled.groupBy("cell_id").agg(
        F.count("*").alias("n"), *(f(a).alias(f"{p}_{a}") for a in AXES for f, p in ((F.min, "lo"), (F.max, "hi")))
    )


class SpatialIndex:
    """Immutable index over points(id, x, y, z)."""

    def __init__(self, points: DataFrame, metric: L2, celled: DataFrame, n: int, leafsize: int, method: str, size: int, top: int):
        self.source, self.metric, self.points, self.n, self.leafsize, self.method = points, metric, celled, n, leafsize, method
        #: Written, as every level is made of it.
        self.cells = written(cell_table(celled))
        #: Bins on an axis of the grid, or halvings of space.
        self._size, self.depth = size, 0
        while self._cells_of(self.depth) > top:
            self.depth += 1

    @classmethod
    def build(cls, points: DataFrame, leafsize: int = 128, boxsize: float | None = None, method: str = "grid", top_cells: int = TOP_CELLS, most_halvings: int | None = None, **ignored) -> SpatialIndex:
        """most_halvings: median cells are split no deeper, whatever the leaf size; all points stay in."""
        if ignored:
            warnings.warn(f"ignored arguments: {sorted(ignored)}", stacklevel=2)
        if leafsize < 1:
            raise ValueError("leafsize must be positive")
        metric = metric_for(boxsize)
        check_domain(points, metric)
        points = points.filter("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
        if not metric.periodic:
            points = points.filter("NOT isnan(x) AND NOT isnan(y) AND NOT isnan(z)")
        stats = points.agg(F.count("*").alias("n"), *(f(a).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "lo"), (F.max, "hi")))).first()
        n = stats["n"]
        want = max(1, math.ceil(n / leafsize))
        if method == "median":
            size = max(0, math.floor(math.log2(want)))
            size = size if most_halvings is None else min(size, most_halvings)
            celled = assign_median_cells(points, size)
        elif method == "grid":
            size = bins = min(1 << 20, max(1, math.floor(want ** (1 / 3) + 1e-9)))
            lo = tuple(stats[f"lo{a}"] or 0.0 for a in AXES)
            side = max([*(stats[f"hi{a}"] - stats[f"lo{a}"] for a in AXES if stats[f"lo{a}"] is not None), 0.0])
            celled = assign_grid_cells(points, lo, side / bins if side > 0 else 1.0, bins)
        else:
            raise ValueError(f"unknown method {method!r}")
        return cls(points, metric, celled, n, leafsize, method, size, top_cells)

    def _cells_of(self, up: int) -> int:
        """Cells of a level at most, so many levels above the finest."""
        return max(1, -(-self._size // 4**up)) ** 3 if self.method == "grid" else 2 ** max(0, self._size - HALVINGS * up)

    def above(self, cell: Column, up: int) -> Column:
        """The cell that holds this one of the finest, so many levels above."""
        if not up:
            return cell
        if self.method == "median":  # not above the root
            return F.greatest(F.shiftright(cell, min(HALVINGS * up, self._size)), F.lit(1))
        b, f = self._size, 4**up
        wide = -(-b // f)
        parts = [F.floor(F.floor(cell / (b * b)) / f), F.floor(F.floor(cell / b) % b / f), F.floor(cell % b / f)]
        return ((parts[0] * wide + parts[1]) * wide + parts[2]).cast("long")

    def level(self, up: int) -> DataFrame:
        """cell_id, n, bounding box and next_id (the cell of the level above) of the cells of a level."""
        least = self.cells.select(self.above(F.col("cell_id"), up + 1).alias("next_id"), self.above(F.col("cell_id"), up).alias("cell_id"), "n", *(f"{p}_{a}" for p in ("lo", "hi") for a in AXES))
        if not up:
            return least
        return least.groupBy("cell_id", "next_id").agg(F.sum("n").alias("n"), *(f(f"{p}_{a}").alias(f"{p}_{a}") for a in AXES for f, p in ((F.min, "lo"), (F.max, "hi"))))

    @property
    def periodic(self) -> bool:
        return self.metric.periodic

    @property
    def boxsize(self) -> float:
        return self.metric.box if self.periodic else 0.0

    @property
    def size(self) -> int:
        """Number of cells."""
        return self.cells.count()

    def coverage_violations(self) -> DataFrame:
        """Ids that aren't in exactly one cell (none, if the index is right)."""
        return self.points.groupBy("id").count().filter("count <> 1")

    def query(self, queries: DataFrame, k: int = 1, **kw) -> DataFrame:
        from lattica.operators.knn import knn_join

        return knn_join(queries, self, k, **kw)
