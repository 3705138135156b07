"""Nearest neighbours, matching and water levels against plain re-statements."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from washline.operators import neighbors as N
from washline.operators import timeline as L
from washline.operators import windows as W

LINES = "target_id long, x1 double, y1 double, x2 double, y2 double"


def segment_distance(x, y, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / n))
    qx, qy = x1 + t * dx, y1 + t * dy
    return math.sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy))


def plain_nearest(points, lines, k, most=float("inf")):
    out = []
    for i, x, y in points:
        if x is None or y is None:
            continue
        d = sorted((segment_distance(x, y, *line[1:]), line[0]) for line in lines if None not in line)
        out += [(i, r + 1, t, dist) for r, (dist, t) in enumerate(d[:k]) if dist <= most]
    return Counter(out)


def scene(seed):
    """Lines and points, thick in one corner; a third of each at one place; NULLs; far-off ones."""
    rng = random.Random(seed)
    spot = lambda: (rng.randrange(100) / 10, rng.randrange(100) / 10) if rng.random() < 0.5 else (rng.randrange(1000) * 1.0, rng.randrange(1000) * 1.0)
    lines = []
    for i in range(300):
        x, y = (5.0, 5.0) if i % 3 == 0 else spot()
        lines.append((i, x, y, x + (rng.randrange(-20, 20) if i % 3 else 1), y + (rng.randrange(-20, 20) if i % 2 and i % 3 else 0)))
    lines += [(900, -5000.0, 0.0, -4000.0, 50.0), (901, None, 1.0, 2.0, 3.0), (902, 0.0, 0.0, 0.0, 0.0)]
    points = [(i, *((6.0, 5.5) if i % 3 == 0 else spot())) for i in range(200)] + [(500, None, 1.0), (501, 9000.0, 9000.0), (502, -4500.0, 25.0)]
    return points, lines


@pytest.mark.parametrize("k, most, leaf", [(1, None, 16), (5, 12.5, 2), (400, None, 16)])
def test_nearest_equals_brute_force(spark, k, most, leaf):
    points, lines = scene(k)
    got = N.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, LINES), k, most, leaf)
    assert Counter(map(tuple, got.collect())) == plain_nearest(points, lines, k, most or float("inf"))


def test_nearest_over_several_groups_of_a_cell(spark, monkeypatch):
    """Points and targets of one cell dealt to many groups, repeated rows among them, text ids."""
    monkeypatch.setattr(N, "BLOCK", 64)
    points, lines = scene(7)
    lines = [(f"t{line[0]}", *line[1:]) for line in lines]
    p = spark.createDataFrame(points + points[:50], "id long, x double, y double")
    t = spark.createDataFrame(lines + lines[:90], LINES.replace("long", "string"))
    assert Counter(map(tuple, N.nearest(p, t, 1, 40.0, 4096).collect())) == plain_nearest(points, lines, 1, 40.0)


def test_few_pairs_of_long_crossing_lines_are_measured(monkeypatch):
    """Lines that all cross the points' area: each point meets few of them, whatever their midpoints."""
    import numpy as np
    rng = random.Random(3)
    lines = [(i, rng.uniform(0, 100), 0.0, rng.uniform(0, 100), 100.0) for i in range(1500)]
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(1500)]
    met, measure = [], N._distances
    monkeypatch.setattr(N, "PAIRS", 1024)
    monkeypatch.setattr(N, "_distances", lambda *of: met.append(measure(*of).size) or measure(*of))
    place, line, distance = N._solve(np.array([p[1:] for p in points]), np.array([t[1:] for t in lines]).T, 2, float("inf"), 1e-7)
    got = {(int(i), int(j)): float(d) for i, j, d in zip(place, line, distance)}
    assert got == {(i, t): d for i, _, t, d in plain_nearest(points, lines, 2)}
    assert sum(met) < len(points) * len(lines) / 3


def test_nearest_of_nothing(spark):
    points, lines = scene(1)
    p, t = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, LINES)
    assert N.nearest(p.where("false"), t).count() == N.nearest(p, t.where("false")).count() == 0
    one = N.nearest(p.where("id = 1"), t.where("target_id = 902"), 2).collect()
    assert [(r.id, r.rank, r.target_id) for r in one] == [(1, 1, 902)]


@pytest.mark.parametrize("m, most, side", [(2, 4.0, 9)])
def test_choice_equals_taking_pairs_in_order(spark, m, most, side):
    rng = random.Random(m)
    damaged = [(f"d{i:03}", float(rng.randrange(side)), float(rng.randrange(side))) for i in range(30)]
    spared = [(f"s{i:03}", float(rng.randrange(side)), float(rng.randrange(side))) for i in range(55)]
    # a crowd around one candidate far from the rest: only its lists must grow, the others keep theirs
    damaged += [(f"e{i:03}", 100.0 + i % 3, 100.0) for i in range(14)] + [("f0", 200.0, 200.0)]
    spared += [(f"t{i:03}", 100.0 + i % 5, 101.0) for i in range(30)] + [(f"u{i}", 200.0, 201.0 + i / 4) for i in range(9)]
    pairs = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), d, s) for d, x, y in damaged for s, u, v in spared)
    used, have, want = set(), Counter(), set()
    for dist, d, s in pairs:
        if dist <= most and s not in used and have[d] < m:
            used.add(s)
            have[d] += 1
            want.add((d, s, dist))
    targets = N.as_targets(spark.createDataFrame(spared, "sid string, x double, y double"), "sid")
    got = N.choose_nearby(spark.createDataFrame(damaged, "id string, x double, y double"), targets, m, most)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert N.choose_nearby(spark.createDataFrame(damaged, "id string, x double, y double").where("false"), targets, m, most).count() == 0


# ---------------------------------------------------------------- water

def readings():
    rng = random.Random(4)
    rows = [("hot", i * 1_000_000 * 600 + rng.randrange(500) * 1_000_000, rng.randrange(40) / 4) for i in range(400)]
    rows += [("b", 0, 1.0), ("b", 0, 3.0), ("b", 7_200_000_000, 3.0), ("b", 9_000_000_000, 0.0), ("b", 99_000_000_000, 5.0), ("b", 100_000_000_000, 5.0)]
    return rows + [("single", 5, 2.0), ("null", None, 1.0), ("null", 3, None), (None, 3, 1.0)]


def plain_intervals(rows, max_gap):
    out, by = [], {}
    for g, t, v in rows:
        if None not in (g, t, v):
            by.setdefault(g, {})[t] = max(v, by.get(g, {}).get(t, v))
    for g, s in by.items():
        s = sorted(s.items())
        out += [(g, t0, l0, t1, l1, (t1 - t0) / 1e6 <= max_gap) for (t0, l0), (t1, l1) in zip(s, s[1:])]
    return out


def plain_water(parts, g, z):
    mine = [p for p in parts if p[0] == g]
    if not mine or z is None:
        return None
    seconds, floods = 0.0, int(mine[0][2] > z)
    for _, t0, l0, t1, l1, ok in mine:
        dt, low, high = (t1 - t0) / 1e6, min(l0, l1), max(l0, l1)
        if not ok:
            floods += l1 > z
            continue
        seconds += dt if z < low else dt * (high - z) / (high - low) if z < high else 0
        floods += l0 <= z < l1
    return round(seconds, 3), floods, max(max(p[2], p[4]) for p in mine)


def test_time_under_water(spark):
    df = spark.createDataFrame(readings(), "gauge string, t long, level double")
    parts = L.reading_intervals(df, 10_000)
    assert Counter(map(tuple, parts.collect())) == Counter(plain_intervals(readings(), 10_000))
    roads = [(i, g, z) for i, (g, z) in enumerate((g, z) for g in ("hot", "b", "single", "none", None) for z in (-1.0, 0.0, 0.25, 2.5, 2.6, 3.0, 5.0, 9.75, 50.0, None))]
    got = L.time_under_water(spark.createDataFrame(roads, "road_id long, gauge string, elevation double"), parts).collect()
    plain = plain_intervals(readings(), 10_000)
    assert len(got) == len(roads)
    for r in got:
        have = None if r.seconds is None else (round(r.seconds, 3), r.floods, r.peak)
        assert have == plain_water(plain, r.gauge, r.elevation), r


def test_level_at_a_time(spark):
    df = spark.createDataFrame(readings(), "gauge string, t long, level double")
    parts = plain_intervals(readings(), 10_000)
    asked = [(g, t, n) for n, (g, t) in enumerate([("hot", i * 333_000_000 - 5_000_000) for i in range(800)]
                                                  + [("b", t) for t in (-1, 0, 3_600_000_000, 8_100_000_000, 50_000_000_000, 99_000_000_000, 200_000_000_000)]
                                                  + [("none", 5), (None, 5), ("hot", None)])]
    got = L.level_at(spark.createDataFrame(asked, "gauge string, t long, n int"), L.reading_intervals(df, 10_000))
    assert got.columns == ["gauge", "t", "n", "level"]
    for r in got.collect():
        mine = [p for p in parts if p[5] and r.t is not None and p[0] == r.gauge and p[1] <= r.t <= p[3]]
        want = None
        if mine:
            _, t0, l0, t1, l1, _ = max(mine, key=lambda p: p[1])
            want = l0 + (l1 - l0) * ((r.t - t0) / (t1 - t0))
        assert (r.level is None) == (want is None) and (want is None or abs(r.level - want) < 1e-9), r
    assert got.count() == len(asked)


def test_asof_takes_the_last_value_over_bucket_borders(spark):
    left = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.createDataFrame([(1, 3, "a"), (1, 1999, "b"), (2, 0, "no")], "k int, t long, v string")
    got = L.asof(left, right, ["k"], "t", ["v"]).collect()
    assert all(r.v == (None if r.t < 3 else "a" if r.t < 1999 else "b") for r in got) and len(got) == 2000


@pytest.mark.parametrize("whole", [0, 5, 50])
def test_water_of_cut_gauges(spark, monkeypatch, whole):
    """The same answers when all gauges, or the larger ones only, are cut into buckets."""
    monkeypatch.setattr(W, "WHOLE_ROWS", whole)
    test_time_under_water(spark)
    test_level_at_a_time(spark)
    test_asof_takes_the_last_value_over_bucket_borders(spark)


def test_small_gauges_need_no_bucket_tables(spark, monkeypatch):
    """Tables beside the readings and roads do not grow with the number of small gauges (but for one row of each with its peak)."""
    sizes, small = [], W.small_side
    for module in (W, L):
        monkeypatch.setattr(module, "small_side", lambda df, *a: sizes.append(df.count()) or small(df, *a))
    rows = [(f"g{i % 300}", i * 1_000_000, i * 7 % 40 / 4) for i in range(1500)]
    parts = L.reading_intervals(spark.createDataFrame(rows, "gauge string, t long, level double"))
    assert parts.count() == 1200
    roads = spark.createDataFrame([(i, f"g{i}", 3.0, 600_000_000) for i in range(300)], "road_id long, gauge string, elevation double, t long")
    assert L.level_at(roads.select("gauge", "t"), parts).where("level is not null").count() == 300
    assert sizes and not any(sizes)
    assert L.time_under_water(roads.drop("t"), parts).where("seconds is not null").count() == 300
    assert sum(sizes) <= 300


def test_large_keys_are_cut_and_others_stay_whole(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).when(F.col("id") > 2900, F.col("id").cast("string")).alias("k"), "id")
    got = {r.k: r for r in W.large_bucket(df, ["k"], "id", 8, 500).groupBy("k").agg(
        F.countDistinct("_bucket").alias("n"), F.count("_bucket").alias("cut"), F.count(F.lit(1)).alias("rows")).collect()}
    assert (got["a"].n, got["a"].cut, got[None].n, got[None].cut) == (8, 2000, 8, got[None].rows)
    assert all((r.n, r.cut) == (0, 0) for k, r in got.items() if k not in ("a", None)) and len(got) > 30
    assert W.large_bucket(df.select("id"), [], "id", 8, 500).select("_bucket").distinct().count() == 8
