"""The same queries as DuckDB SQL, written apart from the plans."""

from __future__ import annotations

import math

P = "p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE)+1.0 AS x, CAST(embedding[2] AS DOUBLE)+1.0 AS y, CAST(embedding[3] AS DOUBLE)+1.0 AS z FROM embeddings)"
V = ("v AS (SELECT CAST(embedding[1] AS DOUBLE)+1.0 AS x, CAST(embedding[2] AS DOUBLE)+1.0 AS y, CAST(embedding[3] AS DOUBLE)+1.0 AS z, "
     "CAST(label AS DOUBLE)+1.0 AS weight, (CAST(label AS DOUBLE)*CAST(0.125 AS DOUBLE)+CAST(0.75 AS DOUBLE))/8.0 AS radius FROM embeddings)")


def D(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _axis2(a: str, b: str, box: float | None) -> str:
    d = f"({a}-{b})"
    return f"({d}*{d})" if box is None else f"least({d}*{d},({d}+{D(box)})*({d}+{D(box)}),({d}-{D(box)})*({d}-{D(box)}))"


def _knn(k: int, box: float | None = None, points: str = "p", queries: str = "p", more: str = "", where: str = "") -> str:
    d2 = f"({_axis2('q.x', 't.x', box)}+{_axis2('q.y', 't.y', box)})+{_axis2('q.z', 't.z', box)}"
    return (f"WITH {P}{more} SELECT qid, CAST(rank AS INTEGER) AS rank, id, sqrt(d2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, id) AS rank "
            f"FROM (SELECT q.id AS qid, t.id AS id, {d2} AS d2 FROM {queries} q, {points} t{where})) WHERE rank <= {k}")


def _box(box: float | None) -> str:
    out = []
    for a, (lo, hi) in zip("xyz", ((0.9, 1.0), (0.95, 1.05), (0.9, 0.98)), strict=True):
        if box is None:
            e = f"(greatest({D(lo)}-{a},0.0::DOUBLE)+greatest({a}-{D(hi)},0.0::DOUBLE))"
        else:
            e = f"(CASE WHEN {a}<{D(lo)} THEN least({D(lo)}-{a},{a}+{D(box)}-{D(hi)}) WHEN {a}>{D(hi)} THEN least({a}-{D(hi)},{D(lo)}+{D(box)}-{a}) ELSE 0.0::DOUBLE END)"
        out.append(f"{e}*{e}")
    return f"WITH {P} SELECT id, ({out[0]}+{out[1]})+{out[2]} AS d2 FROM p"


def _cells(source: str = "p") -> str:
    b = [f"least(greatest(CAST(floor(({a}-0.0::DOUBLE)/0.25::DOUBLE) AS BIGINT),0),7)" for a in "xyz"]
    return f"SELECT *, ({b[0]}*8+{b[1]})*8+{b[2]} AS cell_id FROM {source}"


def _ghosts(source: str, sides: tuple[float, float, float]) -> str:
    """Nested selects: each axis adds the rows moved down and the rows moved up."""
    out = source
    for axis, side in zip("xyz", sides, strict=True):
        if side <= 0:
            continue
        rest = {a: a for a in "xyz"}

        def cols(moved: str, axis=axis, rest=rest) -> str:
            return ", ".join(f"{moved} AS {a}" if a == axis else a for a in rest) + ", weight, radius"

        out = (f"(SELECT x,y,z,weight,radius FROM {out} UNION ALL SELECT {cols(f'{axis}-{D(side)}')} FROM {out} WHERE {axis}+radius>{D(side)} "
               f"UNION ALL SELECT {cols(f'{axis}+{D(side)}')} FROM {out} WHERE {axis}-radius<0)")
    return out


def _volume(sub: int = 4, sides=(-1.0, -1.0, -1.0), gz: int = 16, ppu: float = 8.0, g: int = 16, vertices: str = V) -> str:
    """WITH ... , f(ix, iy, iz, value): sample points joined with spheres, cell by cell."""
    return (
        f"WITH {vertices}, a AS (SELECT x*{D(ppu)} AS cx, y*{D(ppu)} AS cy, z*{D(ppu)} AS cz, weight AS w, radius*{D(ppu)} AS r FROM {_ghosts('v', sides)}), "
        f"sl AS (SELECT a.*, iz, cz-(iz+0.5::DOUBLE) AS zo FROM a, (SELECT CAST(range AS INTEGER) AS iz FROM range({gz})) WHERE r>=0.5 AND r-abs(cz-(iz+0.5::DOUBLE))+1>=0), "
        f"h AS (SELECT *, ceil(sqrt(greatest(0.0::DOUBLE, r*r-zo*zo)))+1 AS half FROM sl), "
        f"px AS (SELECT h.*, ix, iy FROM h, (SELECT CAST(range AS INTEGER) AS ix FROM range({g})), (SELECT CAST(range AS INTEGER) AS iy FROM range({g})) WHERE abs(ix+0.5::DOUBLE-cx)<=half AND abs(iy+0.5::DOUBLE-cy)<=half), "
        f"o AS (SELECT CAST((range+0.5)/{sub} AS DOUBLE) AS o FROM range({sub})), "
        f"c AS (SELECT px.ix, px.iy, px.iz, px.w, px.r, px.cx, px.cy, px.zo, count(*) AS n FROM px, o ox, o oy, o oz "
        f"WHERE ((cx-ix)-ox.o)*((cx-ix)-ox.o)+((cy-iy)-oy.o)*((cy-iy)-oy.o)+((zo+0.5::DOUBLE)-oz.o)*((zo+0.5::DOUBLE)-oz.o) < r*r GROUP BY ALL), "
        # equal spheres fall into one group of c, so samples are counted for all of them at once
        f"b AS (SELECT ix, iy, iz, w/({D(4.0 / 3.0 * math.pi)}*r*r*r)*(n/{D(float(sub**3))}) AS value FROM c), "
        f"s AS (SELECT CAST(floor(cx) AS INTEGER) AS ix, CAST(floor(cy) AS INTEGER) AS iy, CAST(ceil(cz) AS INTEGER)-1 AS iz, w AS value FROM a WHERE r<0.5), "
        f"f AS (SELECT ix, iy, iz, sum(value) AS value FROM (SELECT * FROM b UNION ALL SELECT * FROM s WHERE ix BETWEEN 0 AND {g - 1} AND iy BETWEEN 0 AND {g - 1} AND iz BETWEEN 0 AND {gz - 1}) GROUP BY ix, iy, iz) "
    )


def _index_cells(leaf: int) -> str:
    """The grid that an index of so many points a cell builds: s(bins, lo..., step), g(id, x, y, z, cell_id)."""
    b = [f"least(greatest(CAST(floor(({a}-lo{a})/step) AS BIGINT),0),bins-1)" for a in "xyz"]
    return (
        f"s AS (SELECT bins, lox, loy, loz, side/bins AS step FROM (SELECT CAST(floor(pow(ceil(count(*)/{leaf}.0::DOUBLE), {D(1 / 3)})+1e-9::DOUBLE) AS BIGINT) AS bins, "
        f"min(x) AS lox, min(y) AS loy, min(z) AS loz, greatest(max(x)-min(x),max(y)-min(y),max(z)-min(z)) AS side FROM p)), "
        f"g AS (SELECT p.*, ({b[0]}*bins+{b[1]})*bins+{b[2]} AS cell_id FROM p, s)"
    )


BOXES = "cell_id, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z"


def _query_stats(k: int) -> str:
    near = [f"(greatest(lo_{a}-{a},0.0::DOUBLE)+greatest({a}-hi_{a},0.0::DOUBLE))" for a in "xyz"]
    far = [f"greatest(abs({a}-lo_{a}),abs({a}-hi_{a}))" for a in "xyz"]
    square = lambda v: f"({v[0]}*{v[0]}+{v[1]}*{v[1]})+{v[2]}*{v[2]}"
    return (
        f"WITH {P}, {_index_cells(16)}, c AS (SELECT {BOXES} FROM g GROUP BY cell_id), "
        f"b AS (SELECT p.id AS qid, cell_id, n, {square(near)} AS lo2, {square(far)} AS hi2 FROM p, c), "
        "w AS (SELECT *, sum(n) OVER (PARTITION BY qid ORDER BY hi2, cell_id ROWS UNBOUNDED PRECEDING) AS seen FROM b), "
        f"v AS (SELECT *, lo2 <= coalesce(min(CASE WHEN seen>={k} THEN hi2 END) OVER (PARTITION BY qid), 'inf'::DOUBLE)*{D(1 + 1e-12)} AS visited FROM w) "
        "SELECT qid, count(*) FILTER (WHERE visited) AS cells_visited, count(*) FILTER (WHERE NOT visited) AS cells_pruned, CAST(sum(n) FILTER (WHERE visited) AS BIGINT) AS points_visited FROM v GROUP BY qid"
    )


def _median_cells(leaf: int, levels: int = 12) -> str:
    """Splits at medians, axes in turn, as deep as the number of points calls for."""
    out = f"WITH {P}, depth AS (SELECT CAST(floor(log2(ceil(count(*)/{leaf}.0::DOUBLE))) AS INTEGER) AS deep FROM p), m0 AS (SELECT *, CAST(1 AS BIGINT) AS cell_id FROM p)"
    for i in range(levels):
        axis = "xyz"[i % 3]
        out += f", m{i + 1} AS (SELECT id, x, y, z, CASE WHEN {i} < deep THEN cell_id*2+CAST({axis} > quantile_disc({axis}, 0.5) OVER (PARTITION BY cell_id) AS BIGINT) ELSE cell_id END AS cell_id FROM m{i}, depth)"
    return f"{out} SELECT {BOXES} FROM m{levels} GROUP BY cell_id"


LINE = ("v AS (SELECT CAST(l_quantity AS DOUBLE)/50.0 AS x, CAST(l_discount AS DOUBLE)*10.0 AS y, CAST(l_tax AS DOUBLE)*12.5 AS z, CAST(l_extendedprice AS DOUBLE) AS weight, 0.001::DOUBLE AS radius FROM lineitem)")
OUT = "SELECT ix, iy, iz, round(value, 9) AS value FROM f"
PRICE = "SELECT CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem"


def table() -> dict[str, str]:
    few = ", few AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0.9::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE), (2, 1.0, 1.0, 1.0), (3, 1.2, 1.1, 0.9)) t(id, x, y, z))"
    ties = (", tp AS (SELECT CAST(round(x)*10000+round(y*100)*100+round(z*100) AS BIGINT) AS id, x, y, z FROM (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS z FROM lineitem)), "
            "tq AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), 1.0::DOUBLE, 0.05::DOUBLE, 0.04::DOUBLE), (1, 10.0, 0.05, 0.04), (2, 25.0, 0.05, 0.04), (3, 49.0, 0.05, 0.04)) t(id, x, y, z))")
    knn4 = _knn(4)
    slice2d = V.replace("AS z,", "-1.0 AS z,")
    lookup = "((x-1.0::DOUBLE)*(x-1.0::DOUBLE)+(y-1.05::DOUBLE)*(y-1.05::DOUBLE))+(z-0.95::DOUBLE)*(z-0.95::DOUBLE)"
    border = ("v AS (SELECT * FROM (VALUES (0.1::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.2::DOUBLE), (0.1, 0.1, 1.0, 1.0, 0.2), (0.1, 0.1, 0.1, 1.0, 0.2), (1.0, 1.0, 1.0, 1.0, 0.2)) t(x, y, z, weight, radius))")
    return {
        "knn_l2": knn4, "knn_l2_k1": _knn(1), "knn_exclude_self": _knn(3, where=" WHERE q.id <> t.id"), "knn_periodic": _knn(4, 2.0), "knn_pruned": knn4, "knn_grid": knn4, "knn_periodic_grid": _knn(4, 2.0), "knn_pruned_median": knn4, "knn_periodic_pruned": _knn(4, 2.0),
        "knn_single_point": f"WITH {P} SELECT CAST(row_number() OVER (ORDER BY d2, id) AS INTEGER) AS rank, id, sqrt(d2) AS dist FROM (SELECT id, {lookup} AS d2 FROM p) QUALIFY rank <= 16",
        "knn_k_gt_n": _knn(5, points="few", more=few), "knn_ties": _knn(40, points="tp", queries="tq", more=ties),
        "knn_wide": f"SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, round(sum(dist), 9) AS sum_dist FROM ({knn4}) GROUP BY qid",
        "knn_stats": f"SELECT count(*) AS n_rows, min(dist) AS min_dist, max(dist) AS max_dist, round(sum(CASE WHEN rank=1 THEN dist END), 9) AS sum_nearest FROM ({knn4})",
        "box_distance": _box(None), "box_distance_periodic": _box(2.0),
        "min_distance": f"WITH {P} SELECT min(({_axis2('x', D(1.0), None)}+{_axis2('y', D(1.0), None)})+{_axis2('z', D(1.0), None)}) AS min_d2, min(({_axis2('x', D(0.0), 2.0)}+{_axis2('y', D(0.0), 2.0)})+{_axis2('z', D(0.0), 2.0)}) AS min_periodic_d2 FROM p",
        "domain_violations": f"WITH {P} SELECT count(*) FILTER (WHERE NOT (x BETWEEN 0 AND 1.25 AND y BETWEEN 0 AND 1.25 AND z BETWEEN 0 AND 1.25)) AS violations, count(*) AS n FROM p",
        "cell_assign": f"WITH {P} SELECT id, cell_id FROM ({_cells()})",
        "cell_mbr": f"WITH {P} SELECT cell_id, count(*) AS n, min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y, min(z) AS lo_z, max(z) AS hi_z FROM ({_cells()}) GROUP BY cell_id",
        "cell_coverage": f"WITH {P} SELECT id, CAST(1 AS BIGINT) AS n_cells FROM p",
        "knn_query_stats": _query_stats(4), "median_cells": _median_cells(16), "knn_levels": knn4,
        "knn_batches": f"SELECT r.*, CAST(label AS INTEGER) AS label FROM ({_knn(2)}) r JOIN embeddings e ON e.vec_id = r.qid WHERE qid IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100)",
        "index_properties": f"WITH {P}, {_index_cells(16)}, n AS (SELECT (SELECT count(*) FROM p) AS n, (SELECT count(DISTINCT cell_id) FROM g) AS size) SELECT n, size, false AS periodic, 0.0::DOUBLE AS boxsize FROM n UNION ALL SELECT n, size, true, 2.0::DOUBLE FROM n",
        "random_points": "SELECT CAST(10000 AS BIGINT) AS n, CAST(10000 AS BIGINT) AS n_ids, CAST(10000 AS BIGINT) AS n_inside, CAST(10000 AS BIGINT) AS n_places, true AS even",
        "binary_roundtrip": f"WITH {V} SELECT " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("x", "y", "z", "weight", "radius")) + " FROM v",
        "points_roundtrip": f"WITH {P} SELECT " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in "xyz") + " FROM p",
        "separate_particles": f"WITH {V} SELECT x, y, z, weight, radius FROM v",
        "sphere": _volume(ppu=16.0, vertices="v AS (SELECT 0.5::DOUBLE AS x, 0.5::DOUBLE AS y, 0.5::DOUBLE AS z, 1.0::DOUBLE AS weight, 0.25::DOUBLE AS radius)") + "SELECT round(sum(value), 9) AS total, count(*) FILTER (WHERE value>0) AS occupied, round(max(value) FILTER (WHERE ix=8 AND iy=8 AND iz=8), 9) AS middle FROM f",
        "raw_field": _volume() + "SELECT CAST(4096 AS BIGINT) AS n, count(*) FILTER (WHERE CAST(value AS FLOAT)>0) AS occupied, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 2) AS total FROM f",
        "renderer_size": _volume() + "SELECT 16 AS width, 8 AS height, round(sum(value), 6) AS total FROM f WHERE iy<8",
        "png_slice": _volume() + ", s8 AS (SELECT a.ix, b.iy, round(coalesce(value, 0.0::DOUBLE), 9) AS value FROM (SELECT CAST(range AS INTEGER) AS ix FROM range(16)) a, (SELECT CAST(range AS INTEGER) AS iy FROM range(16)) b LEFT JOIN (SELECT * FROM f WHERE iz=8) f ON f.ix=a.ix AND f.iy=b.iy) SELECT ix, iy, CAST(trunc((value-l)/(h-l)*255.0::DOUBLE) AS INTEGER) AS pixel FROM s8, (SELECT min(value) AS l, max(value) AS h FROM s8)",
        "order_statistic": f"SELECT value FROM ({PRICE}) ORDER BY value LIMIT 1 OFFSET 1000",
        "median_axis": "SELECT CAST(o_totalprice AS DOUBLE) AS value, o_orderkey AS id FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) = (SELECT count(*) FROM orders)//2+1",
        "partition_pivot": f"SELECT count(*) FILTER (WHERE value < 30000) AS split, count(*) AS n, min(value) AS low, max(value) AS high FROM ({PRICE})",
        "partition_sides": f"SELECT CAST(value >= 30000 AS INTEGER) AS side, count(*) AS n, min(value) AS low, max(value) AS high FROM ({PRICE}) GROUP BY 1",
        "median_three": f"WITH {P} SELECT id, list_sort([x, y, z])[2] AS mid FROM p",
        "top_k": "SELECT CAST(o_totalprice AS DOUBLE) AS value FROM orders ORDER BY 1 LIMIT 23",
        "ghosts_3d": f"WITH {V} SELECT * FROM {_ghosts('v', (1.2, 1.2, 1.2))}", "ghosts_partial": f"WITH {V} SELECT * FROM {_ghosts('v', (1.2, -1.0, -1.0))}", "ghosts_border": f"WITH {border} SELECT * FROM {_ghosts('v', (2.0, 2.0, 2.0))}",
        "raster_volume": _volume() + OUT, "raster_volume_s2": _volume(2) + OUT, "raster_periodic": _volume(4, (1.2, 1.2, 1.2)) + OUT,
        "raster_subpixel": _volume(ppu=16.0, vertices=LINE) + OUT.replace("9)", "3)"), "raster_subpixel_periodic": _volume(4, (1.0, 1.0, 1.0), ppu=16.0, vertices=LINE) + OUT.replace("9)", "3)"),
        "raster_slice2d": (
            f"WITH {slice2d}, h AS (SELECT x*8.0::DOUBLE AS cx, y*8.0::DOUBLE AS cy, z*8.0::DOUBLE AS zo, weight AS w, radius*8.0::DOUBLE AS r FROM v), "
            "k AS (SELECT *, ceil(sqrt(greatest(0.0::DOUBLE, r*r-zo*zo)))+1 AS half FROM h WHERE r>=0.5 AND r-abs(zo)+1>=0), "
            "px AS (SELECT k.*, ix, iy FROM k, (SELECT CAST(range AS INTEGER) AS ix FROM range(16)), (SELECT CAST(range AS INTEGER) AS iy FROM range(16)) WHERE abs(ix+0.5::DOUBLE-cx)<=half AND abs(iy+0.5::DOUBLE-cy)<=half), "
            "o AS (SELECT CAST((range+0.5)/4 AS DOUBLE) AS o FROM range(4)), "
            "c AS (SELECT ix, iy, w, r, cx, cy, zo, count(*) AS n FROM px, o ox, o oy, o oz WHERE ((cx-ix)-ox.o)*((cx-ix)-ox.o)+((cy-iy)-oy.o)*((cy-iy)-oy.o)+((zo+0.5::DOUBLE)-oz.o)*((zo+0.5::DOUBLE)-oz.o) < r*r GROUP BY ALL) "
            f"SELECT ix, iy, round(sum(w/({D(4.0 / 3.0 * math.pi)}*r*r*r)*(n/64.0::DOUBLE)), 9) AS value FROM c GROUP BY ix, iy"),
        "raster_dense": _volume() + "SELECT a.ix, b.iy, c.iz, round(coalesce(value, 0.0::DOUBLE), 9) AS value FROM (SELECT CAST(range AS INTEGER) AS ix FROM range(16)) a, (SELECT CAST(range AS INTEGER) AS iy FROM range(16)) b, (SELECT CAST(range AS INTEGER) AS iz FROM range(16)) c LEFT JOIN f ON f.ix=a.ix AND f.iy=b.iy AND f.iz=c.iz",
        "front_slices": _volume(gz=8) + OUT, "central_voxel": _volume() + OUT + " WHERE ix=8 AND iy=8 AND iz=8",
        "field_metrics": _volume() + "SELECT round(sum(value), 6) AS total, count(*) FILTER (WHERE value>0) AS occupied, count(*) FILTER (WHERE value>0)/4096.0::DOUBLE AS occupancy FROM f",
        "mass_ratio": _volume() + "SELECT round(r, 6) AS rendered, round(m, 6) AS mass, round(r/m, 6) AS ratio FROM (SELECT sum(value) AS r FROM f), (SELECT sum(weight) AS m FROM v)",
        "particle_metrics": f"WITH {V} SELECT count(*) AS n, max(radius) AS max_radius, round(avg(radius), 9) AS mean_radius, round(sum(weight), 6) AS mass FROM v",
        "slice_minmax_u8": _volume() + ", s8 AS (SELECT ix, iy, round(value, 9) AS value FROM f WHERE iz=8) SELECT ix, iy, CAST(trunc((value-l)/(h-l)*255.0::DOUBLE) AS INTEGER) AS pixel FROM s8, (SELECT min(value) AS l, max(value) AS h FROM s8)",
        "slice_log1p": _volume() + "SELECT ix, iy, round(ln(1+value), 9) AS value FROM f WHERE iz=8",
    }
