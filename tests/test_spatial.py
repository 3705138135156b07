"""Containment and distance against brute force; boundary and hole cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from washline.operators.spatial import distance_to_polygons, point_in_polygons
from washline.sources.roads import polygon_edges_from_wkt


def _seg_dist(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = 0.0 if l2 == 0 else max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / l2))
    return math.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def _inside(px, py, ring):
    c = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            c = not c
    return c


def test_wkt_polygon_with_hole(spark):
    wkt = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (3 3, 7 3, 7 7, 3 7, 3 3))"
    edges = polygon_edges_from_wkt(spark.createDataFrame([(1, wkt)], "poly_id int, wkt string"))
    assert edges.count() == 8
    pts = spark.createDataFrame([("L", 1, 1.0, 1.0), ("L", 2, 5.0, 5.0), ("L", 3, 20.0, 5.0), ("L", 4, 10.0, 5.0)],
                                "layer string, id int, x double, y double")
    got = {r.id: r.Inundated for r in point_in_polygons(pts, edges.withColumn("layer", F.lit("L")), ["layer"], "id", band=2.0).collect()}
    assert got[1] is True and got[2] is False and got[3] is False
    assert got[4] is False          # on the right edge: not contained


def test_containment_and_distance_match_brute_force(spark):
    rnd = random.Random(11)
    rings = []
    for pid in range(6):
        cx, cy, r = rnd.uniform(100, 900), rnd.uniform(100, 900), rnd.uniform(20, 120)
        ring = [(cx + r * (0.4 + 0.6 * (i % 2)) * math.cos(i * math.pi / 5), cy + r * (0.4 + 0.6 * (i % 2)) * math.sin(i * math.pi / 5))
                for i in range(10)]
        rings.append((pid, ring))
    edge_rows = [("L", pid, 0, i, a[0], a[1], b[0], b[1]) for pid, ring in rings
                 for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    edges = spark.createDataFrame(edge_rows, "layer string, poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [("L", i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(800)]
    pdf = spark.createDataFrame(pts, "layer string, id int, x double, y double")
    flags = {r.id: r.Inundated for r in point_in_polygons(pdf, edges, ["layer"], "id", band=25.0).collect()}
    dists = {r.id: r.distance for r in distance_to_polygons(pdf, edges, ["layer"], "id", cell=40.0).collect()}
    for _, i, x, y in pts:
        assert flags[i] == any(_inside(x, y, ring) for _, ring in rings)
        want = min(_seg_dist(x, y, *e[4:]) for e in edge_rows)
        assert dists[i] == pytest.approx(want, abs=1e-9)


def test_large_polygon_registers_what_it_crosses(spark):
    """One polygon of 2,000 edges and 100 km: rows follow the cells crossed; far and inner points are right."""
    from washline.operators.spatial import corner_ranges, edge_cells
    rnd = random.Random(5)
    ring = [(50_000 * (0.8 + 0.2 * rnd.random()) * math.cos(2 * math.pi * i / 2000), 50_000 * (0.8 + 0.2 * rnd.random()) * math.sin(2 * math.pi * i / 2000))
            for i in range(2000)]
    square = [(60_000.0, 0.0), (60_500.0, 0.0), (60_500.0, 500.0), (60_000.0, 500.0)]        # horizontal and vertical edges
    rows = [("L", pid, 0, i, *a, *b) for pid, r in ((1, ring), (2, square)) for i, (a, b) in enumerate(zip(r, r[1:] + r[:1]))]
    edges = spark.createDataFrame(rows, "layer string, poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    cell = 100.0
    length = sum(abs(r[4] - r[6]) + abs(r[5] - r[7]) for r in rows)
    assert edge_cells(edges, cell).count() <= len(rows) * 4 + 2 * length / cell
    crossed = sum(abs(r[5] - r[7]) / cell + 1 for r in rows)
    assert corner_ranges(edges, cell, ["layer"]).count() <= 24 * crossed
    pts = [(rnd.uniform(-55_000, 55_000), rnd.uniform(-55_000, 55_000)) for _ in range(150)]
    pts += [(60_250.0, 250.0), (60_500.5, 10.0), (70_500.0, 250.0), (60_250.0, -10_000.0), (0.0, 0.0), (200_000.0, 200_000.0)]
    pdf = spark.createDataFrame([("L", i, x, y) for i, (x, y) in enumerate(pts)], "layer string, id int, x double, y double")
    flags = {r.id: r.Inundated for r in point_in_polygons(pdf, edges, ["layer"], "id", band=cell).collect()}
    dists = {r.id: r.distance for r in distance_to_polygons(pdf, edges, ["layer"], "id", cell=cell).collect()}
    for i, (x, y) in enumerate(pts):
        assert flags[i] == (_inside(x, y, ring) or _inside(x, y, square)), (i, x, y)
        assert dists[i] == pytest.approx(min(_seg_dist(x, y, *e[4:]) for e in rows), abs=1e-6)


def test_overlaps_holes_and_layers(spark):
    """Overlapping polygons, a polygon inside a hole, other layers, points at round coordinates, a layer without polygons."""
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = [("A", 1, [box(0, 0, 100), box(20, 20, 60)]), ("A", 2, [box(40, 40, 20)]), ("A", 3, [box(90, 90, 40)]), ("B", 1, [box(0, 0, 10)])]
    rows = [(lay, pid, k, i, *map(float, a), *map(float, b)) for lay, pid, rings in shapes for k, r in enumerate(rings)
            for i, (a, b) in enumerate(zip(r, r[1:] + r[:1]))]
    edges = spark.createDataFrame(rows, "layer string, poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [(lay, i * 100 + j, i * 7.0 + 0.5, j * 7.0 + 0.25) for lay in "ABC" for i in range(20) for j in range(20)]
    pts += [("A", 9000 + k, float(x), float(y)) for k, (x, y) in enumerate([(50, 50), (10, 10), (30, 30), (95, 95), (110, 110), (75, 50)])]
    pdf = spark.createDataFrame(pts, "layer string, id int, x double, y double")
    for band in (5.0, 30.0, 1000.0):
        flags = {(r.layer, r.id): r.Inundated for r in point_in_polygons(pdf, edges, ["layer"], "id", band=band).collect()}
        for lay, i, x, y in pts:
            want = any(sum(_inside(x, y, [tuple(map(float, v)) for v in r]) for r in rings) % 2 for name, _, rings in shapes if name == lay)
            assert flags[(lay, i)] == want, (band, lay, x, y)
    assert {r.distance for r in distance_to_polygons(pdf.where("layer = 'C'"), edges, ["layer"]).collect()} == {None}


def test_points_are_not_shuffled_by_id_and_repeated_ids_are_one_point(spark):
    from washline.operators.spatial import distance_to_polygons, point_in_polygons

    ring = [(10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0)]
    edges = spark.createDataFrame([("a", 1, 0, i, *p, *q) for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1]))],
                                  "layer string, poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    schema = "layer string, id string, x double, y double"
    own = spark.createDataFrame([("a", "in", 50.0, 50.0), ("a", "edge cell", 12.0, 40.0), ("a", "out", 5.0, 40.0), ("b", "no layer", 50.0, 50.0),
                                 ("a", "no place", None, 1.0)], schema)
    flag = point_in_polygons(own, edges, ["layer"])
    dist = distance_to_polygons(own, edges, ["layer"])
    assert {r.id: r.Inundated for r in flag.collect()} == {"in": True, "edge cell": True, "out": False, "no layer": False, "no place": False}
    assert {r.id: r.distance for r in dist.collect()} == {"in": 40.0, "edge cell": 2.0, "out": 5.0, "no layer": None, "no place": None}
    for df in (flag, dist):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    # places that share an id are one point: inside if one is, as near as the nearest
    both = spark.createDataFrame([("a", "two", 50.0, 50.0), ("a", "two", 5.0, 40.0), ("a", "in", 30.0, 50.0)], schema)
    assert sorted((r.id, r.x, r.Inundated) for r in point_in_polygons(both, edges, ["layer"]).collect()) == [("in", 30.0, True), ("two", 5.0, True), ("two", 50.0, True)]
    assert sorted((r.id, r.x, r.distance) for r in distance_to_polygons(both, edges, ["layer"]).collect()) == [("in", 30.0, 20.0), ("two", 5.0, 5.0), ("two", 50.0, 5.0)]


def test_edges_are_worked_out_in_batches(spark, monkeypatch):
    """no lambda over a cell's edges runs row by row; points in pieces, repeated ids, places without an answer."""
    from washline.operators import spatial as P
    rnd = random.Random(5)
    rings = [[(20.0 * k + rnd.uniform(-9, 9), rnd.uniform(-40, 40)) for _ in range(7)] for k in range(6)]
    rows = [("L", k, 0, i, *a, *b) for k, ring in enumerate(rings) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    edges = spark.createDataFrame(rows, "layer string, poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    pts = [("L", i, rnd.uniform(-20, 130), rnd.uniform(-50, 50)) for i in range(400)]
    points = spark.createDataFrame([*pts, ("L", 900, None, 1.0), ("none", 901, 1.0, 1.0)], "layer string, id int, x double, y double")
    monkeypatch.setattr(P, "PAIRS", 16)
    near = distance_to_polygons(points, edges, ["layer"], "id", cell=8.0)
    flag = point_in_polygons(points, edges, ["layer"], "id", band=8.0)
    for df in (near, flag):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan and "aggregate(" not in plan
    d = {r.id: r.distance for r in near.collect()}
    inside = {r.id: r.Inundated for r in flag.collect()}
    for _, i, x, y in pts:
        assert d[i] == pytest.approx(min(_seg_dist(x, y, *r[4:]) for r in rows), abs=1e-12)
        assert inside[i] == any(_inside(x, y, ring) for ring in rings)
    assert d[900] is None and d[901] is None and inside[900] is False and inside[901] is False
    # the same place twice under one id: its flips add up to an even number, wherever an edge crosses the cell
    twice = point_in_polygons(points.where("id < 40").unionByName(points.where("id < 40")), edges, ["layer"], "id", band=8.0).collect()
    assert len(twice) == 80
