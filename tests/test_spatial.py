import json
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from swardshift.operators import neighbours as nb
from swardshift.operators import spatial as sp
from swardshift.sources import features as ft

EDGE = "poly string, x1 double, y1 double, x2 double, y2 double"


def ring(name, pts):
    return [(name, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1])]


def inside(px, py, edges):
    n = 0
    for _, x1, y1, x2, y2 in edges:
        if (y1 <= py) != (y2 <= py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            n += 1
    return n % 2 == 1


def test_points_in_odd_shapes(spark):
    rng = random.Random(2)
    polys = {}
    for i in range(8):
        cx, cy = rng.uniform(-5, 5), rng.uniform(-5, 5)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(12))
        polys[f"p{i}"] = ring(f"p{i}", [(cx + rng.uniform(0.3, 3) * math.cos(a), cy + rng.uniform(0.3, 3) * math.sin(a))
                                        for a in angles])
    # A hole, two parts, a sliver through many cells, and a polygon within one cell.
    polys["hole"] = ring("hole", [(-4, -4), (4, -4), (4, 4), (-4, 4)]) + ring("hole", [(-1, -1), (-1, 1), (1, 1), (1, -1)])
    polys["parts"] = ring("parts", [(-6, -6), (-5, -6), (-5, -5)]) + ring("parts", [(5, 5), (6, 5), (6, 6)])
    polys["sliver"] = ring("sliver", [(-6, -6), (6, 5.9), (6, 6)])
    polys["tiny"] = ring("tiny", [(0.10, 0.10), (0.12, 0.10), (0.12, 0.12), (0.10, 0.12)])
    pts = [(i, rng.uniform(-7, 7), rng.uniform(-7, 7)) for i in range(600)] + [(600, 0.11, 0.115), (601, 0.0, -0.01)]
    # A third of all points at one place.
    pts += [(700 + i, 0.111, 0.113) for i in range(300)]
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = sorted((i, name) for i, x, y in pts for name, e in polys.items() if inside(x, y, e))
    for size in (0.25, 1.7):
        assert rows(sp.points_in_polygons(points, edges, ["id"], ["poly"], size)) == want


def test_no_table_of_cells_is_broadcast(spark, monkeypatch):
    """Rows spread over cells look small to Spark: joins must not send them to the driver, however small they are taken for."""
    edges = spark.createDataFrame(ring("a", [(0, 0), (3, 0), (3, 3), (0, 3)]) + ring("b", [(1, 1), (1, 2), (2, 2), (2, 1)]), EDGE)
    pts = [(i, 0.013 * i, 1.01 + 0.001 * i) for i in range(300)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    monkeypatch.setattr(sp, "CELL_POINTS", 4, raising=False)  # most cells are dealt to several pieces
    sent = []
    inside_ = sp.points_in_polygons(points, edges, ["id"], ["poly"])
    near = sp.nearest_polygons(points, edges, ["id"], ["poly"], 20_000.0, apart=inside_.select("id").distinct())
    for df in (inside_, near):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent += [line for line in plan.splitlines() if "BroadcastExchange" in line]
        assert "SortMergeJoin" in plan
    assert len(sent) <= 2  # the counts of points per cell, a row for each cell with points
    want = sorted((i, name) for i, x, y in pts for name, lo, hi in (("a", 0, 3), ("b", 1, 2)) if lo < x < hi and lo < y < hi)
    assert rows(inside_) == want


@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_points_and_edges_of_a_cell_meet_as_lists(spark, monkeypatch, at_once):
    """Many overlapping polygons: no pair of a point and an edge becomes a row; which points lie in any polygon of a group is asked for alone."""
    monkeypatch.setattr(sp, "PAIRS_AT_ONCE", at_once, raising=False)
    rng = random.Random(11)
    polys = {}
    for k in range(60):
        x, y, w = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0.2, 1.4)
        polys[f"p{k}", k % 3] = ring(f"p{k}", [(x, y + w), (x - w, y), (x, y - w), (x + w, y)]) + ring(f"p{k}", [(x, y + w / 4), (x + w / 4, y), (x, y - w / 4), (x - w / 4, y)])
    pts = [(i, rng.uniform(-3, 3), rng.uniform(-3, 3)) for i in range(250)] + [(None, -0.3, 0.2), (900, None, 0.1)]
    edges = spark.createDataFrame([(p, g, *e[1:]) for (p, g), es in polys.items() for e in es], "poly string, grp int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = {(i, p, g) for i, x, y in pts if x is not None for (p, g), es in polys.items() if inside(x, y, es)}
    found = sp.points_in_polygons(points, edges, ["id"], ["poly", "grp"])
    assert "FlatMapCoGroups" in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = [tuple(r) for r in sp.points_in_polygons(points, edges, ["id"], ["poly", "grp"], any_of=["grp"]).collect()]
    assert len(some) == len(set(some)) and set(some) == {(i, g) for i, _, g in want}


def test_boundary_points_are_outside(spark):
    edges = spark.createDataFrame(ring("box", [(0, 0), (1, 0), (1, 1), (0, 1)]), EDGE)
    pts = [(1, 0.0, 0.5), (2, 0.5, 0.0), (3, 1.0, 0.5), (4, 0.5, 1.0), (5, 0.0, 0.0), (6, 0.5, 0.5)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    assert rows(sp.points_in_polygons(points, edges, ["id"], ["poly"])) == [(6, "box")]


def test_dense_coast_in_one_grid_row(spark):
    """A ragged coast whose edges all lie in one row of cells: a point meets only the edges of its own cell."""
    rng = random.Random(3)
    coast = [(k / 1000, 0.01 + 0.22 * rng.random()) for k in range(1, 8000)]
    poly = ring("coast", [(0.0, -1.0), (8.0, -1.0), (8.0, 0.1), *coast[::-1], (0.0, 0.1)])
    pts = [(i, rng.uniform(-0.5, 8.5), rng.uniform(-0.1, 0.3)) for i in range(900)] + [(2000, 4.0, -0.5), (2001, 4.0, -1.5)]
    edges = spark.createDataFrame(poly, EDGE)
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = sorted((i, "coast") for i, x, y in pts if inside(x, y, poly))
    assert rows(sp.points_in_polygons(points, edges, ["id"], ["poly"])) == want
    tiles, in_cells = sp.polygon_tiles(edges, ["poly"], 0.25)
    most = in_cells.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
    assert most < 1.2 * 250 + 10  # an even share of the edges, not the row's
    assert tiles.groupBy("cx", "cy").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("size", [0.25, 0.5, 1.0])
def test_corners_on_grid_lines(spark, size):
    """Edges along cell borders, corners on cell corners, points on grid lines."""
    polys = {
        "box": ring("box", [(0, 0), (1, 0), (1, 1), (0, 1)]),
        "steps": ring("steps", [(-2, -2), (0, -2), (0, -1), (0.5, -1), (0.5, -0.5), (1, -0.5), (1, 0), (-2, 0)]),
        "diamond": ring("diamond", [(2, 0), (3, 1), (2, 2), (1, 1)]),
        "frame": ring("frame", [(-3, 1), (-1, 1), (-1, 3), (-3, 3)]) + ring("frame", [(-2.5, 1.5), (-2.5, 2.5), (-1.5, 2.5), (-1.5, 1.5)]),
    }
    spots = [(x / 4 + dx, y / 4 + dy) for x in range(-13, 13) for y in range(-9, 13) for dx, dy in ((0.125, 0.0625), (0.0, 0.0625), (0.0625, 0.0))]

    def on_edge(x, y, e):
        return any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) for _, x1, y1, x2, y2 in e)

    pts = [(i, x, y) for i, (x, y) in enumerate(spots)]
    want = sorted((i, n) for i, x, y in pts for n, e in polys.items() if inside(x, y, e) and not on_edge(x, y, e))
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    assert rows(sp.points_in_polygons(points, edges, ["id"], ["poly"], size)) == want


def test_nearest_against_all_edges(spark):
    """Many small polygons: the nearest of all within the cap, whatever the size of the last cells."""
    rng = random.Random(6)
    polys = {}
    for k in range(120):
        x, y, w = rng.uniform(0, 2), rng.uniform(0, 2), rng.uniform(0.005, 0.05)
        polys[f"p{k}"] = ring(f"p{k}", [(x, y), (x + w, y), (x + w, y + w * rng.uniform(0.2, 2)), (x, y + w)])
    pts = [(i, rng.uniform(-0.2, 2.2), rng.uniform(-0.2, 2.2)) for i in range(300)]
    merc = lambda lon, lat: (6378137 * math.radians(lon), 6378137 * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)))

    def dist(p, e):
        (px, py), (ax, ay), (bx, by) = merc(*p), merc(e[1], e[2]), merc(e[3], e[4])
        t = max(0.0, min(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    want = {}
    for i, x, y in pts:
        d, name = min((min(dist((x, y), e) for e in es), n) for n, es in polys.items())
        if d < 20_000:
            want[i] = (name, round(d, 3))
    edges = spark.createDataFrame([e for p in polys.values() for e in p], EDGE)
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    for cell in (100.0, 3000.0, 20_000.0):
        got = sp.nearest_polygons(points, edges, ["id"], ["poly"], 20_000.0, cell_m=cell).collect()
        assert {r["id"]: (r["poly"], round(r["dist_m"], 3)) for r in got} == want


def test_nearest_keeps_ties_and_cap(spark):
    box = [(0, 0), (1, 0), (1, 1), (0, 1)]
    edges = spark.createDataFrame(ring("AA", box) + ring("AA1", box) + ring("BB", [(2, 0), (3, 0), (3, 1)]), EDGE)
    points = spark.createDataFrame([(1, -0.01, 0.5), (2, -0.1, 0.5), (3, 1.98, 0.0)], "id long, lon double, lat double")
    got = sp.nearest_polygons(points, edges, ["id"], ["poly"], 5000.0).collect()
    assert sorted((r["id"], r["poly"]) for r in got) == [(1, "AA"), (1, "AA1"), (3, "BB")]
    assert {round(r["dist_m"], 3) for r in got if r["id"] == 1} == {round(6378137 * math.radians(0.01), 3)}


def test_nearest_within_each_vintage(spark):
    edges = spark.createDataFrame(
        [(p, y, *e[1:]) for p, y, w in (("AA", 2003, 1.0), ("CC", 2010, 0.99)) for e in ring(p, [(0, 0), (w, 0), (w, 1), (0, 1)])],
        "poly string, year int, x1 double, y1 double, x2 double, y2 double",
    )
    points = spark.createDataFrame([(1, 1.02, 0.5), (2, 1.02, 0.5)], "id long, lon double, lat double")
    apart = spark.createDataFrame([(2, 2010)], "id long, year int")
    got = sp.nearest_polygons(points, edges, ["id"], ["poly"], same=["year"], apart=apart)
    assert rows(got.select("id", "year", "poly")) == [(1, 2003, "AA"), (1, 2010, "CC"), (2, 2003, "AA")]


def test_area_of_box_with_hole(spark):
    outer = ring("a", [(10, 50), (11, 50), (11, 51), (10, 51)])
    hole = ring("a", [(10.2, 50.2), (10.2, 50.4), (10.4, 50.4), (10.4, 50.2)])
    area = sp.polygon_area_km2(spark.createDataFrame(outer + hole, EDGE), ["poly"]).first()["area_km2"]
    r = 6371.01
    band = lambda s, n, w: r * r * math.radians(w) * (math.sin(math.radians(n)) - math.sin(math.radians(s)))
    assert area == pytest.approx(band(50, 51, 1) - band(50.2, 50.4, 0.2), rel=0.01)


def test_rings_are_closed_and_cleaned(spark):
    v = [("a", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    v += [("b", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])]
    fixed = sp.normalise_rings(spark.createDataFrame(v, "poly string, ring int, seq int, x double, y double"), ["poly"])
    assert rows(fixed.groupBy("poly", "usable").agg(F.count("*"))) == [("a", True, 5), ("b", False, 3)]
    edges = sp.ring_edges(spark.createDataFrame(v, "poly string, ring int, seq int, x double, y double"), ["poly"])
    assert edges.count() == 4 and edges.where("x2 = 0 and y2 = 0").count() == 1


def test_region_key_patches_and_drops(spark):
    edges = spark.createDataFrame(
        [(p, 2003, *e[1:]) for p in ("AA", "AA1") for e in ring(p, [(0, 0), (1, 0), (1, 1), (0, 1)])]
        + [(p, 2006, *e[1:]) for p in ("AA",) for e in ring(p, [(0, 0), (2, 0), (2, 1), (0, 1)])],
        "region_id string, year int, x1 double, y1 double, x2 double, y2 double",
    )
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.02, 0.5)], "pid long, lon double, lat double")
    got = rows(sp.region_key(points, edges, ["pid"]).select("pid", "year", "level", "region_id"))
    assert got == [(1, 2003, 0, "AA"), (1, 2003, 1, "AA1"), (1, 2006, 0, "AA"), (2, 2006, 0, "AA")]
    patched = sp.region_key(points, edges, ["pid"], keep_patched=True).where("area_km2 is null")
    assert rows(patched.select("pid", "year", "level", "region_id")) == [(2, 2021, 0, "AA"), (2, 2021, 1, "AA1")]


def test_patched_rows_take_part_in_conflicts(spark):
    edges = spark.createDataFrame(
        [("AA", 2010, *e[1:]) for e in ring("AA", [(0, 0), (1, 0), (1, 1), (0, 1)])]
        + [("BB", 2021, *e[1:]) for e in ring("BB", [(1, 0), (2, 0), (2, 1), (1, 1)])],
        "region_id string, year int, x1 double, y1 double, x2 double, y2 double",
    )
    # Outside AA by a kilometre in 2010, inside BB in 2021: both rows bear 2021 and are seen once, so both lose.
    points = spark.createDataFrame([(1, 1.009, 0.5), (2, 1.5, 0.5)], "pid long, lon double, lat double")
    for kept in (False, True):
        got = rows(sp.region_key(points, edges, ["pid"], keep_patched=kept).select("pid", "year", "region_id"))
        assert got == [(2, 2021, "BB")]


def haversine(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return round(2 * 6371010 * math.asin(math.sqrt(h)), 3)


@pytest.mark.parametrize("leaf", [2, 64])
def test_neighbours_equal_brute_force(spark, leaf):
    rng = random.Random(7)
    pts = [(i, rng.uniform(-180, 180), rng.uniform(-88, 88), rng.choice("ab")) for i in range(150)]
    # A dense town, a third of all points at one place, both sides of the date line, and a rare class.
    pts += [(200 + i, 10 + rng.uniform(0, 0.01), 50 + rng.uniform(0, 0.01), rng.choice("ab")) for i in range(100)]
    pts += [(400 + i, 10.005, 50.005, "ab"[i % 2]) for i in range(130)]
    pts += [(600, 179.99, 0.0, "a"), (601, -179.99, 0.0, "b"), (602, 179.99, 0.1, "b"), (603, 5.0, 5.0, "c"), (604, 6.0, 5.0, "c")]
    rng.shuffle(pts)
    df = spark.createDataFrame(pts, "id long, lon double, lat double, cls string")
    found = nb.nearest_other_class(df, 3, "id", "lon", "lat", "cls", leaf_locations=leaf)
    own = df.join(found, ["cls", "lon", "lat"])
    got = {}
    for r in own.collect():
        got.setdefault((r["id"], r["partner_cls"]), []).append((r["rank"], r["dist_m"], r["partner_id"]))
    want = {}
    for i, lon, lat, c in pts:
        for other in "abc":
            if other != c:
                near = sorted((haversine((lon, lat), (x, y)), j) for j, x, y, d in pts if d == other)[:3]
                want[i, other] = [(n + 1, d, j) for n, (d, j) in enumerate(near)]
    assert set(got) == set(want)
    for k in want:
        g = sorted(got[k])
        assert [(n, j) for n, _, j in g] == [(n, j) for n, _, j in want[k]], k
        assert [d for _, d, _ in g] == pytest.approx([d for _, d, _ in want[k]], abs=0.0015)


def test_neighbour_features_are_strict(spark):
    pts = [(1, 0.0, 0.0, "a", 1.0), (2, 0.0, 0.1, "b", 4.0), (3, 0.0, 0.2, "b", None), (4, 0.0, 9.0, "b", 2.0)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double, cls string, v double")
    got = {r["id"]: r for r in nb.neighbour_features(df, ["v"], 2, "id", "lon", "lat", "cls").collect()}
    assert got[1]["partner_v"] is None and got[1]["partner_vdiff"] is None
    assert got[2]["partner_v"] == 1.0 and got[2]["partner_vdiff"] == 3.0
    assert got[1]["median_dist"] == pytest.approx(6371010 * math.radians(0.15), abs=0.01)


def test_leaves_meet_lists_of_partners(spark, monkeypatch):
    """What a leaf is given is a row for each partner leaf, not for each partner; leaves hold more than a few points."""
    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 30), rng.uniform(30, 50), "ab"[i % 2]) for i in range(3000)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double, cls string")
    leaves, given = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = nb._nearest_in_leaf

    def counted(k):
        run = real(k)

        def nearest(left, right):
            leaves.add(1)
            given.add(right.num_rows)
            return run(left, right)

        return nearest

    monkeypatch.setattr(nb, "_nearest_in_leaf", counted)
    assert len(nb.nearest_other_class(df, 5, "id", "lon", "lat", "cls").collect()) == 5 * len(pts)
    assert leaves.value < len(pts) / 8 and given.value < 20 * leaves.value


def test_no_product_of_all_pairs_in_plans(spark):
    edges = spark.createDataFrame(ring("AA", [(0, 0), (1, 0), (1, 1)]), EDGE)
    points = spark.createDataFrame([(1, 0.5, 0.2)], "id long, lon double, lat double")
    for df in (sp.points_in_polygons(points, edges, ["id"], ["poly"]), sp.nearest_polygons(points, edges, ["id"], ["poly"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_geojson(spark, tmp_path):
    points = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"point_id": 7, "LC": "B1"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}
    (tmp_path / "p.json").write_text(json.dumps(points))
    assert rows(ft.read_points(spark, str(tmp_path / "p.json"), "point_id:bigint,LC:string")) == [(7, "B1", 1.5, 2.5)]
    (tmp_path / "q.json").write_text(json.dumps(points, indent=2))
    assert rows(ft.read_points(spark, str(tmp_path / "q.json"), "point_id:bigint,LC:string")) == [(7, "B1", 1.5, 2.5)]
    (tmp_path / "bad.json").write_text(json.dumps(points["features"][0]) + "\n{not json\n")
    with pytest.raises(Exception):
        ft.read_points(spark, str(tmp_path / "bad.json"), "point_id:bigint,LC:string").collect()
    shell, hole = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [1, 2], [2, 2], [1, 1]]
    poly = [
        {"type": "Feature", "properties": {"region_id": "AA"}, "geometry": {"type": "Polygon", "coordinates": [shell, hole]}},
        {"type": "Feature", "properties": {"region_id": "BB"}, "geometry": {"type": "MultiPolygon", "coordinates": [[shell], [hole]]}},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(f) for f in poly))
    got = ft.read_yearly_polygons(spark, {2003: str(tmp_path / "r.json"), 2006: str(tmp_path / "r.json")})
    assert rows(got.groupBy("region_id", "year", "ring").count()) == [
        (p, y, r, n) for p in ("AA", "BB") for y in (2003, 2006) for r, n in ((0, 5), (1, 4))]
    edges = sp.ring_edges(got, ["region_id", "year"])
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.3, 1.6)], "id long, lon double, lat double")
    found = sp.points_in_polygons(points, edges, ["id"], ["region_id", "year"])
    assert rows(found) == [(1, p, y) for p in ("AA", "BB") for y in (2003, 2006)]


def test_raster_outside_and_missing(spark):
    layers = spark.createDataFrame([("l1", 0.0, 10.0, 1.0, 1.0), ("l2", 0.0, 10.0, 5.0, 5.0)],
                                   "layer string, x0 double, y0 double, dx double, dy double")
    pixels = spark.createDataFrame([("l1", 0, 0, 1.0), ("l1", 9, 3, 2.0), ("l2", 1, 0, 3.0)],
                                   "layer string, row int, col int, value double")
    points = spark.createDataFrame([(1, 0.5, 9.5), (2, 3.5, 0.5), (3, -1.0, 5.0), (4, 0.6, 9.6)], "id long, x double, y double")
    assert rows(ft.raster_sample(pixels, layers, points, ["id"])) == [
        (1, "l1", 1.0), (1, "l2", None), (2, "l1", 2.0), (2, "l2", 3.0), (3, "l1", None), (3, "l2", None),
        (4, "l1", 1.0), (4, "l2", None)]
