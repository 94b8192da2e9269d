import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import SpatialIndex, knn_join, render_points_volume
from lattica.functions.extents import extent, period
from lattica.functions.metrics import L2, PeriodicL2
from lattica.operators import field, ghosts, index, knn, selection
from lattica.sources import points as src
from lattica.sources import sinks


def cloud(n, box=1.0, seed=42):
    return np.random.default_rng(seed).random((n, 3)) * box


def naive(points, queries, k, box=None):
    d = queries[:, None, :] - points[None, :, :]
    if box:
        d = np.abs(d)
        d = np.minimum(d, box - d)
    d2 = (d[..., 0] ** 2 + d[..., 1] ** 2) + d[..., 2] ** 2
    order = np.lexsort((np.broadcast_to(np.arange(len(points)), d2.shape), d2), axis=1)[:, :k]
    return order, np.sqrt(np.take_along_axis(d2, order, 1))


@pytest.mark.parametrize("box", [None, 2.0])
@pytest.mark.parametrize("method", ["brute", "grid", "median", "cells"])
def test_knn_equals_naive(spark, box, method):
    p, q = cloud(2000, 2.0), cloud(60, 2.0, 7)
    pts, qs = src.points_from_numpy(spark, p), src.points_from_numpy(spark, q)
    got = knn.knn_brute(qs, pts, 4, box) if method == "brute" else knn.knn_grid(qs, pts, 4, box) if method == "cells" else SpatialIndex.build(pts, 32, box, method).query(qs, 4)
    rows = got.orderBy("qid", "rank").toPandas()
    ids, dist = naive(p, q, 4, box)
    assert rows["id"].tolist() == ids.ravel().tolist()
    assert np.allclose(rows["dist"], dist.ravel())


def test_k_larger_than_n_and_wide(spark):
    pts = src.points_from_numpy(spark, cloud(3))
    got = knn_join(pts, pts, 5)
    assert got.count() == 9
    wide = {r.qid: r for r in knn.to_wide(got, 5, "sentinel").collect()}
    assert wide[0].ids[0] == 0 and wide[0].ids[-1] == 4294967295 and len(wide[0].dists) == 5
    dist, ids = sinks.knn_to_numpy(got, 5)
    assert dist.shape == (3, 5) and ids[0, 4] == 4294967295
    more = src.points_from_numpy(spark, cloud(4))
    dist, ids = sinks.knn_to_numpy(got, 5, queries=more)  # the last has no neighbour
    assert ids.shape == (4, 5) and (ids[3] == 4294967295).all() and ids[2, 0] == 2


def test_grid_with_far_and_clustered_queries(spark):
    r = np.random.default_rng(5)
    p = np.vstack([r.random((400, 3)) * 0.02, r.random((300, 3)), [[0.5, 0.5, 0.5]] * 9])
    q = np.vstack([r.random((20, 3)), [[9.0, 9.0, 9.0], [-3.0, 0.1, 0.2], [0.5, 0.5, 0.5]]])
    pts, qs = src.points_from_numpy(spark, p), src.points_from_numpy(spark, q)
    for k in (1, 5):
        rows = knn_join(qs, pts, k, strategy="grid").orderBy("qid", "rank").toPandas()
        ids, dist = naive(p, q, k)
        assert rows["id"].tolist() == ids.ravel().tolist() and np.allclose(rows["dist"], dist.ravel())
    few = src.points_from_numpy(spark, p[:3])
    assert knn_join(qs, few, 5, strategy="grid").count() == 3 * len(q)
    near = knn_join(pts, pts, 1, strategy="grid", exclude_self=True).filter("qid = id")
    assert near.count() == 0


def test_points_outside_the_box(spark):
    p = np.vstack([cloud(20), [[3.1, 0.5, 0.5]]])
    pts, qs = src.points_from_numpy(spark, p), src.points_from_numpy(spark, cloud(3))
    for call in (
        lambda: knn_join(qs, pts, 1, 1.0), lambda: knn_join(qs, pts, 1, 1.0, strategy="grid"), lambda: knn_join(qs, pts, 1, 1.0, strategy="index"),
        lambda: knn.knn_lookup(pts, (0.1, 0.1, 0.1), 1, 1.0), lambda: SpatialIndex.build(pts, boxsize=1.0), lambda: knn.knn_brute(qs, pts, 1, 1.0), lambda: knn.knn_grid(qs, pts, 1, 1.0),
    ):
        with pytest.raises(ValueError):
            call()
    assert knn_join(qs, pts, 1).count() == 3


def test_columns_of_queries_and_their_number(spark):
    p = cloud(50)
    pts = src.points_from_numpy(spark, p)
    qs = pts.withColumn("batch", F.col("id") % 3).withColumn("name", F.lit("q"))
    got = knn_join(qs, pts, 2, keep=("batch", "name"), max_queries=10)
    assert got.columns == ["qid", "rank", "id", "dist", "batch", "name"] and got.count() == 20
    assert all(r.batch == r.qid % 3 and r.qid < 10 for r in got.collect())
    with pytest.raises(ValueError):
        knn_join(qs.withColumnRenamed("name", "rank"), pts, keep=["rank"])


def test_brute_force_is_for_few_points(spark):
    many = src.random_points(spark, knn.BRUTE_LIMIT + 1)
    with pytest.raises(ValueError):
        knn_join(many.limit(3), many, 1, strategy="brute")


@pytest.mark.parametrize("method, box", [("median", None), ("grid", 2.0), ("grid", None), ("median", 2.0)])
def test_levels_of_an_index(spark, method, box):
    """So few cells on the first level that there are several below it."""
    p, q = cloud(1500, 2.0), cloud(25, 2.0, 9)
    idx = SpatialIndex.build(src.points_from_numpy(spark, p), 8, box, method, top_cells=3)
    assert idx.depth >= 1 and idx.level(idx.depth).count() <= 3
    for up in range(idx.depth + 1):
        assert idx.level(up).agg(F.sum("n")).first()[0] == 1500
        assert idx.level(up).groupBy("cell_id").count().filter("count > 1").count() == 0
    rows = idx.query(src.points_from_numpy(spark, q), 4).orderBy("qid", "rank").toPandas()
    ids, dist = naive(p, q, 4, box)
    assert rows["id"].tolist() == ids.ravel().tolist() and np.allclose(rows["dist"], dist.ravel())


@pytest.mark.parametrize("method", ["grid", "median"])
def test_stats_whatever_the_levels(spark, method):
    p = src.points_from_numpy(spark, cloud(1500, 2.0))
    q = src.points_from_numpy(spark, cloud(25, 2.0, 9))
    flat, high = (SpatialIndex.build(p, 8, None, method, top_cells=t) for t in (100_000, 3))
    assert flat.depth == 0 and high.depth > 0
    one, two = (sorted(map(tuple, knn.query_stats(q, i, 4).collect())) for i in (flat, high))
    assert one == two and len(one) == 25 and all(r[1] + r[2] == flat.size for r in one)


@pytest.mark.parametrize("ranked", [index.RANKED, 3000])
def test_median_cells_are_exact(spark, ranked):
    """Cells of more points than approximate quantiles tell apart, ties, and a place that holds a tenth of the points."""
    r = np.random.default_rng(3)
    p = np.vstack([r.random((30_000, 3)), r.integers(0, 40, (5000, 3)) / 40, np.full((4000, 3), 0.25)])
    r.shuffle(p)
    cell = np.ones(len(p), dtype=np.int64)
    for d in range(9):
        v, out = p[:, d % 3], cell * 2
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            out[at] += v[at] > np.sort(v[at])[(len(at) + 1) // 2 - 1]
        cell = out
    got = index.assign_median_cells(src.points_from_numpy(spark, p), 9, ranked).orderBy("id").toPandas()
    assert got["id"].tolist() == list(range(len(p))) and got["cell_id"].tolist() == cell.tolist()


def test_plan_of_median_cells_stays_small(spark):
    cells = SpatialIndex.build(src.points_from_numpy(spark, cloud(4096)), 4, None, "median").cells
    assert len(cells._jdf.queryExecution().logical().toString()) < 20_000


def test_crowded_cells_go_to_the_index(spark):
    """Points so clustered that a uniform grid would have them in few cells."""
    r = np.random.default_rng(8)
    p = np.vstack([0.5 + r.standard_normal((9000, 3)) * 1e-4, r.random((1000, 3))])
    q = np.vstack([0.5 + r.standard_normal((8, 3)) * 1e-4, r.random((4, 3))])
    pts = src.points_from_numpy(spark, p)
    got = knn.knn_grid(src.points_from_numpy(spark, q), pts, 3).orderBy("qid", "rank").toPandas()
    ids, dist = naive(p, q, 3)
    assert got["id"].tolist() == ids.ravel().tolist() and np.allclose(got["dist"], dist.ravel())
    sizes = SpatialIndex.build(pts, method="median").cells.agg(F.max("n")).first()[0]
    assert sizes < 300


def test_cancelled_actions(spark):
    import time

    from lattica.operators.jobs import Cancelled, run_cancellable

    assert run_cancellable(spark, lambda: spark.range(10).count()) == 10
    with pytest.raises(ZeroDivisionError):
        run_cancellable(spark, lambda: 1 / 0)
    slow = src.random_points(spark, 400_000)
    began = time.time()
    with pytest.raises(Cancelled):
        run_cancellable(spark, lambda: slow.crossJoin(slow.limit(50_000).withColumnRenamed("x", "w")).agg(F.sum(F.sin("w") * F.cos(slow["x"]))).collect(), lambda: time.time() > began + 1.5)
    assert time.time() - began < 60


def test_particles_of_separate_tables(spark):
    ids = spark.range(5)
    pos = ids.select("id", *(F.col("id").cast("double").alias(a) for a in "xyz"))
    w, r = ids.select("id", F.lit(2.0).alias("weight")), ids.select("id", (F.col("id") * 0.5).alias("radius"))
    assert sorted(map(tuple, src.particles_from(pos, w, r).collect())) == [(float(i),) * 3 + (2.0, i * 0.5) for i in range(5)]
    for bad in (r.filter("id > 0"), r.union(r)):
        with pytest.raises(ValueError):
            src.particles_from(pos, w, bad)


def test_bad_arguments(spark):
    pts = src.points_from_numpy(spark, cloud(5))
    with pytest.raises(ValueError):
        knn_join(pts, pts, 0)
    with pytest.raises(ValueError):
        SpatialIndex.build(pts, boxsize=0.1)
    with pytest.raises(ValueError):
        src.points(pts, columns=("x", "y", "w"))
    with pytest.warns(UserWarning):
        SpatialIndex.build(pts, unknown=1)


def test_nan_and_null_positions(spark):
    pts = spark.createDataFrame([(0, 0.1, 0.1, 0.1), (1, float("nan"), 0.0, 0.0), (2, None, 0.0, 0.0)], "id long, x double, y double, z double")
    q = spark.createDataFrame([(9, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert [r.id for r in knn.knn_brute(q, pts, 3).collect()] == [0]


def test_index_properties(spark):
    idx = SpatialIndex.build(src.points_from_numpy(spark, cloud(1000)), 16, 1.0, "median")
    assert idx.n == 1000 and idx.periodic and idx.boxsize == 1.0 and 1 < idx.size <= 64
    assert idx.coverage_violations().count() == 0
    assert index.domain_violations(idx.points, 0.5).first()["violations"] > 0
    s = knn.query_stats(idx.source.limit(5), idx, 4).toPandas()
    assert (s.points_visited >= 4).all() and (s.cells_pruned > 0).any()


def test_periodic_box_distance_equals_images(spark):
    p = cloud(100)
    lo, hi = np.array([0.2, 0.4, 0.0]), np.array([0.5, 0.6, 0.1])
    m = PeriodicL2(1.0)
    got = src.points_from_numpy(spark, p).select("id", m.box_min2([F.col(a) for a in "xyz"], [F.lit(v) for v in lo.tolist()], [F.lit(v) for v in hi.tolist()]).alias("d")).orderBy("id").toPandas()["d"]
    best = np.full(100, np.inf)
    for s in np.stack(np.meshgrid(*[[-1, 0, 1]] * 3), -1).reshape(-1, 3):
        d = np.maximum(lo - (p + s), 0) + np.maximum((p + s) - hi, 0)
        best = np.minimum(best, (d**2).sum(1))
    assert np.allclose(got, best, atol=1e-6)
    assert not L2().periodic


@pytest.mark.parametrize("k", [0, 50, 99])
def test_order_statistic(spark, k):
    v = np.random.default_rng(1).integers(0, 40, 100).tolist()
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(v)], "v double, id long")
    want = sorted((float(x), i) for i, x in enumerate(v))[k]
    assert tuple(selection.order_statistic(df, "v", k, ("id",)).first()) == want
    for limit in (0, 1, 10):
        assert tuple(selection.order_statistic(df, "v", k, ("id",), limit=limit).first()) == want
    assert selection.partition_counts(df, "v", 20.0).first()["split"] == sum(x < 20 for x in v)
    assert sorted(r.v for r in selection.top_k_smallest(df, "v", 7).collect()) == sorted(map(float, v))[:7]


def test_order_statistic_of_ties(spark):
    v = [5.0] * 400 + [1.0] * 30 + [7.0] * 30 + [5.5, float("nan"), None]
    df = spark.createDataFrame([(x, i % 7, str(i)) for i, x in enumerate(v)], "v double, a long, b string")
    rows = sorted((x, i % 7, str(i)) for i, x in enumerate(v) if x is not None and x == x)
    for k in (0, 29, 30, 200, 429, 430, 431, 460):
        assert tuple(selection.order_statistic(df, "v", k, ("a", "b"), limit=5).first()) == rows[k]
        assert selection.order_statistic(df, "v", k, limit=5).first().v == rows[k][0]
    with pytest.raises(ValueError):
        selection.order_statistic(df, "v", 461)


def model(parts, ppu, g, s):
    out = np.zeros((g, g, g))
    off = (np.arange(s) + 0.5) / s
    for x, y, z, w, r in parts:
        X, Y, Z, R = x * ppu, y * ppu, z * ppu, r * ppu
        if R < 0.5:
            i, j, k = int(np.floor(X)), int(np.floor(Y)), int(np.ceil(Z)) - 1
            if 0 <= min(i, j, k) and max(i, j, k) < g:
                out[i, j, k] += w
            continue
        for k in range(g):
            zo = Z - (k + 0.5)
            if R - abs(zo) + 1 < 0:
                continue
            half = np.ceil(np.sqrt(max(0.0, R * R - zo * zo))) + 1
            for i in range(g):
                for j in range(g):
                    if abs(i + 0.5 - X) <= half and abs(j + 0.5 - Y) <= half:
                        d = ((X - i - off[:, None, None]) ** 2 + (Y - j - off[None, :, None]) ** 2) + (zo + 0.5 - off[None, None, :]) ** 2
                        out[i, j, k] += w / (4 / 3 * np.pi * R**3) * (d < R * R).sum() / s**3
    return out


@pytest.mark.parametrize("s", [1, 3, 4])
def test_raster_equals_model(spark, s):
    parts = [(0.5, 0.5, 0.5, 1.0, 0.25), (0.1, 0.9, 0.4, 2.0, 0.12), (0.3, 0.3, 0.3, 5.0, 0.001), (1.05, 0.2, 0.2, 1.0, 0.1)]
    v = spark.createDataFrame(parts, "x double, y double, z double, weight double, radius double")
    got = sinks.to_numpy(render_points_volume(v, 12.0, 12, False, s), (12, 12, 12))
    assert np.allclose(got, model(parts, 12.0, 12, s), atol=1e-6)


def test_periodic_mass_and_ghost_counts(spark):
    rows = [(0.1, 1.0, 1.0), (0.1, 0.1, 1.0), (0.1, 0.1, 0.1), (1.0, 1.0, 1.0)]
    for (x, y, z), n in zip(rows, (2, 4, 8, 1), strict=True):
        v = spark.createDataFrame([(x, y, z, 1.0, 0.2)], "x double, y double, z double, weight double, radius double")
        assert ghosts.add_ghosts(v, (2.0, 2.0, 2.0)).count() == n
        mass = render_points_volume(v, 16.0, 32, True).agg(F.sum("value")).first()[0]
        assert abs(mass - 1) < 0.01


def test_empty_and_extents(spark):
    v = src.single_sphere(spark).filter("x > 2")
    assert render_points_volume(v, 8.0, 8).count() == 0
    assert extent(4, 3) == (4, 4, 4) and period((1, 2, 3), True) == (1.0, 2.0, 3.0) and period((1, 2, 3), 2) == (2.0,) * 3
    assert period((1, 2, 3), (5.0, 6.0)) == (5.0, 6.0, -1.0)
    with pytest.raises(ValueError):
        extent(0, 2)


def test_sinks(spark, tmp_path):
    f = render_points_volume(src.single_sphere(spark), 16.0, 16)
    s = field.slice_of(f, 8)
    sinks.write_png(s, (16, 16), str(tmp_path / "a.png"))
    pixels = sinks.png_pixels((tmp_path / "a.png").read_bytes())
    assert pixels.shape == (16, 16) and pixels.max() == 255 and pixels.min() == 0
    sinks.write_raw_float32(f, (16, 16, 16), str(tmp_path / "a.bin"))
    back = np.fromfile(tmp_path / "a.bin", "<f4").reshape((16, 16, 16), order="F")
    assert np.array_equal(back, sinks.to_numpy(f, (16, 16, 16)))
    pts = cloud(100).astype("<f4")
    (tmp_path / "p.bin").write_bytes(pts.tobytes())
    got = src.read_points_binary(spark, str(tmp_path / "p.bin")).toPandas().to_numpy()
    assert np.array_equal(np.sort(got, 0), np.sort(pts.astype(float), 0))
    sinks.write_records(src.read_points_binary(spark, str(tmp_path / "p.bin")), ("x", "y", "z"), f"file://{tmp_path}/q.bin")
    assert np.array_equal(np.fromfile(tmp_path / "q.bin", "<f4").reshape(-1, 3), pts)


def test_scratch_tables_go(spark):
    import os

    from lattica.sources import scratch

    at = lambda df: df._scratch.removeprefix("file://")
    a = scratch.written(spark.range(3))
    assert a.count() == 3 and os.path.isdir(at(a))
    kept: list = []
    with scratch.cleaned(kept):
        b, c = scratch.written(a), scratch.written(a)
        kept.append(c)
    assert os.path.isdir(at(a)) and not os.path.isdir(at(b)) and os.path.isdir(at(c))
    scratch.discard(a, c, spark.range(2))
    assert not os.path.isdir(at(a)) and not os.path.isdir(at(c))


def test_stream(spark, tmp_path):
    from lattica.streaming.fields import start_volume, stream_volume

    v = src.random_points(spark, 50, 3).withColumn("weight", F.lit(1.0)).withColumn("radius", F.lit(0.1)).drop("id")
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    q = start_volume(stream_volume(stream, 8.0, 8), "stream_field", str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    a = sinks.to_numpy(spark.table("stream_field"), (8, 8, 8))
    assert np.allclose(a, sinks.to_numpy(render_points_volume(spark.read.parquet(str(tmp_path / "in")), 8.0, 8), (8, 8, 8)), atol=1e-5)
