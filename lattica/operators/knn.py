"""Exact k-nearest-neighbour joins. Result rows: qid, rank (from 1), id, dist; ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.metrics import AXES, L2, metric_for
from lattica.operators.index import SpatialIndex, check_domain
from lattica.sources.scratch import written

#: Point tables up to so many rows may be compared with every query.
BRUTE_LIMIT = 20_000
#: Cells on each side that the grid's second round may look at; points of a cell beyond which a uniform grid is given up.
RINGS, CROWDED = 6, 4_096


def _check_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise ValueError("k must be a positive integer")


def _queries(queries: DataFrame, metric: L2) -> DataFrame:
    return queries.select(F.col("id").alias("qid"), *(metric.wrap(F.col(a).cast("double")).alias(f"q{a}") for a in AXES)).dropna(subset=[f"q{a}" for a in AXES])


def _d2(metric: L2):
    return metric.dist2([F.col(f"q{a}") for a in AXES], [F.col(a) for a in AXES])


def _top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k-limit is applied before the shuffle too, by Spark's window group limit; roots are taken of the survivors only."""
    order = Window.partitionBy("qid").orderBy("d2", "id")
    return pairs.filter("d2 IS NOT NULL AND NOT isnan(d2)").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", F.sqrt("d2").alias("dist"))


def knn_brute(queries: DataFrame, points: DataFrame, k: int = 1, boxsize: float | None = None, exclude_self: bool = False) -> DataFrame:
    """Every query against every point, which are broadcast: for tables of at most BRUTE_LIMIT points, others are refused."""
    _check_k(k)
    metric = metric_for(boxsize)
    check_domain(points, metric)
    if points.limit(BRUTE_LIMIT + 1).count() > BRUTE_LIMIT:
        raise ValueError(f"more than {BRUTE_LIMIT} points: use the grid or an index")
    pairs = _queries(queries, metric).crossJoin(F.broadcast(points.select("id", *AXES)))
    if exclude_self:
        pairs = pairs.filter("qid <> id")
    return _top_k(pairs.select("qid", "id", _d2(metric).alias("d2")), k)


def candidate_cells(queries: DataFrame, index: SpatialIndex, k: int) -> DataFrame:
    """(qid, cell_id, visited) of the finest cells that are looked at: cells ordered by the farthest distance they can hold
    give a bound on the k-th distance; a cell is visited if its nearest distance is within it. The first level is broadcast; on
    each further one, the cells inside those visited are met by an equi-join."""
    m = index.metric
    position = [f"q{a}" for a in AXES]
    q, lo, hi = [F.col(a) for a in position], [F.col(f"lo_{a}") for a in AXES], [F.col(f"hi_{a}") for a in AXES]
    seen = Window.partitionBy("qid").orderBy("hi2", "cell_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = F.min(F.when(F.col("seen") >= k, F.col("hi2"))).over(Window.partitionBy("qid"))
    asked = _queries(queries, m).crossJoin(F.broadcast(index.level(index.depth)))
    for up in range(index.depth, -1, -1):
        near = asked.select("qid", *position, "cell_id", "n", m.box_min2(q, lo, hi).alias("lo2"), m.box_max2(q, lo, hi).alias("hi2"))
        out = near.withColumn("seen", F.sum("n").over(seen)).withColumn("bound", F.coalesce(bound, F.lit(float("inf")))).withColumn("visited", F.col("lo2") <= F.col("bound") * (1 + 1e-12))
        if up:
            inside = out.filter("visited").select("qid", *position, F.col("cell_id").alias("next_id"))
            asked = inside.join(index.level(up - 1), "next_id")
    return out


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """By a key, over enough tasks for rows that are few before a join and many after it."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _bounded(queries: DataFrame, index: SpatialIndex, k: int) -> DataFrame:
    """The queries, each with a bound on its k-th distance: from the first level down, the cell of k points or more that is
    nearest by its farthest corner, and in the last one the k-th of some of its points. A row stays a row at every step."""
    m, position = index.metric, [f"q{a}" for a in AXES]
    q = [F.col(a) for a in position]

    def best(cells: Column) -> Column:
        far = F.transform(F.filter(cells, lambda c: c["n"] >= k), lambda c: F.struct(m.box_max2(q, [c[f"lo_{a}"] for a in AXES], [c[f"hi_{a}"] for a in AXES]).alias("hi2"), c["cell_id"].alias("at")))
        return F.array_min(far)

    box = F.struct("cell_id", "n", *(f"{p}_{a}" for p in ("lo", "hi") for a in AXES))
    top = index.level(index.depth).agg(F.collect_list(box).alias("cells"))
    out = _queries(queries, m).crossJoin(F.broadcast(top)).withColumn("best", best(F.col("cells"))).select("qid", *position, F.col("best.hi2").alias("bound"), F.col("best.at").alias("at"))
    for up in range(index.depth - 1, -1, -1):
        inner = index.level(up).groupBy("next_id").agg(F.collect_list(box).alias("cells"))
        met = _dealt(out, "at").join(inner, F.col("at") == F.col("next_id"), "left").withColumn("best", best(F.col("cells")))
        out = met.select("qid", *position, F.least("bound", "best.hi2").alias("bound"), F.col("best.at").alias("at"))
    nth = Window.partitionBy("cell_id").orderBy("id")
    some = index.points.select("cell_id", "id", *AXES).withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= max(64, k))
    some = some.groupBy("cell_id").agg(F.collect_list(F.struct(*AXES)).alias("some"))
    near = F.array_sort(F.transform("some", lambda t: m.dist2(q, [t[a] for a in AXES])))
    met = _dealt(out, "at").join(some, F.col("at") == F.col("cell_id"), "left")
    return met.select("qid", *position, F.coalesce(F.least("bound", F.get(near, F.lit(k - 1))), F.lit(float("inf"))).alias("bound"))


def knn_pruned(queries: DataFrame, index: SpatialIndex, k: int = 1, exclude_self: bool = False) -> DataFrame:
    """Branch and bound, a set at a time: each query goes with its bound from level to level, into the cells that are as near; only
    points of such cells are compared, by an equi-join."""
    _check_k(k)
    m, position = index.metric, [f"q{a}" for a in AXES]
    q, lo, hi = [F.col(a) for a in position], [F.col(f"lo_{a}") for a in AXES], [F.col(f"hi_{a}") for a in AXES]
    # distances across a periodic side are rounded in another order than those to boxes
    reach = F.col("bound") * (1 + 1e-9) + F.lit(1e-18 * m.box**2)
    cells = _bounded(queries, index, k + exclude_self).crossJoin(F.broadcast(index.level(index.depth).drop("next_id")))
    for up in range(index.depth, -1, -1):
        cells = cells.filter(m.box_min2(q, lo, hi) <= reach).select("qid", *position, "bound", "cell_id")
        if up:
            cells = _dealt(cells.withColumnRenamed("cell_id", "next_id"), "next_id").join(index.level(up - 1), "next_id")
    pairs = _dealt(cells, "cell_id").join(index.points.select("cell_id", "id", *AXES), "cell_id").withColumn("d2", _d2(m)).filter(F.col("d2") <= F.col("bound"))
    if exclude_self:
        pairs = pairs.filter("qid <> id")
    return _top_k(pairs.select("qid", "id", "d2"), k)


def _near(c: Column, m: Column, bins: int, periodic: bool) -> Column:
    """Cells at most m away on one axis, each once."""
    if periodic:
        low, high = F.least(m, F.lit((bins - 1) // 2)), F.least(m, F.lit(bins // 2))
        return F.transform(F.sequence(-low, high), lambda o: F.pmod(c + o, F.lit(bins)))
    low, high = F.greatest(c - m, F.lit(0)), F.least(c + m, F.lit(bins - 1))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def knn_grid(queries: DataFrame, points: DataFrame, k: int = 1, boxsize: float | None = None, exclude_self: bool = False, occupancy: int | None = None) -> DataFrame:
    """Equi-joins on grid cells, whose number grows with the points: nothing is broadcast, and a query meets a bounded
    neighbourhood whatever the size of the table.

    A block of m cells on each side holds every point within m cell widths. The first round looks one cell around; a query
    whose k-th distance is larger than that asks again for the block that its distance calls for. Queries far from the
    points, with more to look at than RINGS, are left to the index, and so are all if some cell holds more than CROWDED points, as
    where points are clustered: the index splits space at medians. Query ids must be unique.
    """
    _check_k(k)
    metric = metric_for(boxsize)
    check_domain(points, metric)
    k_in = k + exclude_self
    stats = points.agg(F.count("*").alias("n"), *(f(a).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "lo"), (F.max, "hi")))).first()
    low = [0.0 if metric.periodic else stats[f"lo{a}"] or 0.0 for a in AXES]
    side = metric.box if metric.periodic else max([*(stats[f"hi{a}"] - stats[f"lo{a}"] for a in AXES if stats[f"lo{a}"] is not None), 0.0]) or 1.0
    bins = min(1 << 20, max(1, int((stats["n"] / (occupancy or max(4, k_in))) ** (1 / 3))))
    width = side / bins

    def key(parts):
        return (parts[0] * bins + parts[1]) * bins + parts[2]

    at = [F.least(F.greatest(F.floor((F.col(a) - o) / width), F.lit(0)), F.lit(bins - 1)) for a, o in zip(AXES, low, strict=True)]
    celled = points.select("id", *AXES, key(at).alias("cell_id"))
    if (celled.groupBy("cell_id").count().agg(F.max("count")).first()[0] or 0) > max(CROWDED, 4 * k_in):
        return knn_pruned(queries, SpatialIndex.build(points, boxsize=boxsize, method="median"), k, exclude_self)
    asked = _queries(queries, metric)

    def block(pending: DataFrame) -> DataFrame:
        out = pending
        for a, o in zip(AXES, low, strict=True):
            c = F.floor((F.col(f"q{a}") - o) / width)
            c = F.pmod(c, F.lit(bins)) if metric.periodic else c
            out = out.withColumn(f"c{a}", F.explode(_near(c, F.col("m"), bins, metric.periodic)))
        pairs = out.withColumn("cell_id", key([F.col(f"c{a}") for a in AXES])).join(celled, "cell_id")
        if exclude_self:
            pairs = pairs.filter("qid <> id")
        d2 = pairs.select("qid", "m", "id", _d2(metric).alias("d2")).filter("d2 IS NOT NULL AND NOT isnan(d2)")
        every = Window.partitionBy("qid")
        top = d2.withColumn("rank", F.row_number().over(every.orderBy("d2", "id"))).filter(F.col("rank") <= k)
        sure = (F.count("*").over(every) == k) & (F.sqrt(F.max("d2").over(every)) <= F.col("m") * width * (1 - 1e-9))
        return written(top.withColumn("far", F.sqrt(F.max("d2").over(every))).withColumn("n", F.count("*").over(every)).withColumn("sure", sure | (2 * F.col("m") + 1 >= 2 * bins)))

    def rows(top: DataFrame) -> DataFrame:
        return top.filter("sure").select("qid", "rank", "id", F.sqrt("d2").alias("dist"))

    first = block(asked.withColumn("m", F.lit(1).cast("long")))
    seen = first.filter("rank = 1").select("qid", "n", "far", "sure")
    left = asked.join(seen, "qid", "left").filter("sure IS NULL OR NOT sure")
    need = F.when(F.col("n") == k, F.ceil(F.col("far") / width * (1 + 1e-6))).otherwise(F.lit(3)).cast("long")
    second = block(left.withColumn("m", need).filter(F.col("m") <= RINGS).select("qid", *(f"q{a}" for a in AXES), "m"))
    done = rows(first).unionByName(rows(second))
    rest = written(asked.join(done.filter("rank = 1"), "qid", "left_anti").select(F.col("qid").alias("id"), *(F.col(f"q{a}").alias(a) for a in AXES)))
    if rest.limit(1).count():
        done = done.unionByName(knn_pruned(rest, SpatialIndex.build(points, boxsize=boxsize), k, exclude_self))
    return done


def knn_join(
    queries: DataFrame, points: DataFrame | SpatialIndex, k: int = 1, boxsize: float | None = None, exclude_self: bool = False, strategy: str = "auto", leafsize: int = 128,
    keep: Sequence[str] = (), max_queries: int | None = None,
) -> DataFrame:
    """Picks the plan by the number of points: nested loop up to BRUTE_LIMIT, the grid beyond. strategy: auto, brute, index or
    grid; a SpatialIndex is used as it is.

    keep: further columns of the queries that the result has too, such as those that group them into batches. max_queries: only
    so many queries, those with the smallest ids, are asked. Points outside a periodic box raise ValueError; queries are wrapped.
    """
    _check_k(k)
    if strategy not in ("auto", "brute", "index", "grid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if max_queries is not None:
        queries = queries.orderBy("id").limit(max_queries)
    if keep:
        clash = {"qid", "rank", "id", "dist"} & set(keep)
        if clash:
            raise ValueError(f"the result has columns of these names: {sorted(clash)}")
        found = knn_join(queries, points, k, boxsize, exclude_self, strategy, leafsize)
        return found.join(queries.select(F.col("id").alias("qid"), *(F.col(f"`{c}`") for c in keep)), "qid").select("qid", "rank", "id", "dist", *(F.col(f"`{c}`") for c in keep))
    if isinstance(points, SpatialIndex):
        return knn_pruned(queries, points, k, exclude_self)
    if strategy == "auto":
        strategy = "brute" if points.limit(BRUTE_LIMIT + 1).count() <= BRUTE_LIMIT else "grid"
    if strategy == "brute":
        return knn_brute(queries, points, k, boxsize, exclude_self)
    if strategy == "grid":
        return knn_grid(queries, points, k, boxsize, exclude_self)
    return knn_pruned(queries, SpatialIndex.build(points, leafsize, boxsize), k, exclude_self)


def knn_lookup(points: DataFrame, position: tuple[float, float, float], k: int = 1, boxsize: float | None = None) -> DataFrame:
    """Neighbours of one position: a top-k scan without a join."""
    _check_k(k)
    metric = metric_for(boxsize)
    check_domain(points, metric)
    d2 = metric.dist2([metric.wrap(F.lit(float(v))) for v in position], [F.col(a) for a in AXES])
    best = points.select("id", d2.alias("d2")).filter("d2 IS NOT NULL AND NOT isnan(d2)").orderBy("d2", "id").limit(k)
    return best.select(F.row_number().over(Window.orderBy("d2", "id")).alias("rank"), "id", F.sqrt("d2").alias("dist"))


def to_wide(result: DataFrame, k: int, pad: str | None = None) -> DataFrame:
    """One row per query: arrays of ids and distances by rank, padded to k with null or with the sentinel."""
    rows = result.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("near"))
    ids, dist = F.col("near.id"), F.col("near.dist")
    if pad:
        fill_id, fill = {"null": (F.lit(None).cast("long"), F.lit(None).cast("double")), "sentinel": (F.lit(4294967295).cast("long"), F.sqrt(F.lit(3.4028234663852886e38)))}[pad]
        ids = F.concat(ids, F.array_repeat(fill_id, F.lit(k) - F.size(ids)))
        dist = F.concat(dist, F.array_repeat(fill, F.lit(k) - F.size(dist)))
    return rows.select("qid", ids.alias("ids"), dist.alias("dists"))


def knn_stats(result: DataFrame) -> DataFrame:
    return result.agg(F.count("*").alias("n_rows"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.round(F.sum(F.when(F.col("rank") == 1, F.col("dist"))), 9).alias("sum_nearest"))


def query_stats(queries: DataFrame, index: SpatialIndex, k: int) -> DataFrame:
    """Per query: cells visited, all others (pruned, at whichever level), points visited. Levels leave the visited ones as they
    are: a cell as near as the bound lies in cells above that are as near as theirs."""
    met = candidate_cells(queries, index, k).filter("visited").select("qid", "n", F.lit(1).alias("cells"), F.lit(0).alias("asked"))
    asked = _queries(queries, index.metric).select("qid", F.lit(None).cast("long").alias("n"), F.lit(0).alias("cells"), F.lit(1).alias("asked"))
    visited = F.sum("cells").alias("cells_visited")
    out = met.unionByName(asked).groupBy("qid").agg(visited, (F.sum("asked") * F.lit(index.size) - F.sum("cells")).alias("cells_pruned"), F.sum("n").alias("points_visited"))
    return out.filter("cells_visited > 0")
