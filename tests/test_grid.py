"""The decision tree grid against trees grown one node at a time in plain Python."""

import math
import random
from itertools import product

import pytest

from washline.operators.grid import DECIMALS, grid_search

GRID = {"class_weight": [None, "balanced"], "criterion": ["gini", "entropy"], "max_depth": [1, 3, None],
        "min_samples_leaf": [1, 4], "min_samples_split": [2, 9]}


def fixture_rows(n=140, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.choice([None, *range(8)]), rng.randrange(30) / 4
        y = int((a or 0) + b + rng.randrange(7) > 11)
        out.append((i % 5, y, None if a is None else float(a), b))
    return out


def plain_grid(rows, grid, folds=5):
    def impurity(group, weight, criterion):
        q = [sum(weight[y] for _, y in group if y == k) for k in (0, 1)]
        w = sum(q)
        if criterion == "gini":
            return (q[0] ** 2 + q[1] ** 2) / w
        return sum(v * math.log2(v / w) for v in q if v)

    def grow(group, depth, weight, criterion, leaf, limit, least):
        n1 = sum(y for _, y in group)
        says = int(n1 * weight[1] > (len(group) - n1) * weight[0])
        best = None
        if 0 < n1 < len(group) and depth != limit and len(group) >= least:
            for f in range(2):
                values = sorted({x[f] for x, _ in group})
                for lo, hi in zip(values, values[1:]):
                    sides = [g for g in group if g[0][f] <= lo], [g for g in group if g[0][f] > lo]
                    if min(map(len, sides)) < leaf:
                        continue
                    whole = sum(weight[y] for _, y in group)
                    score = round(sum(impurity(s, weight, criterion) for s in sides) / whole, DECIMALS)
                    if best is None or score > best[0]:
                        best = score, f, lo / 2 + hi / 2, sides
        if best is None:
            return says
        return (best[1], best[2], *[grow(s, depth + 1, weight, criterion, leaf, limit, least) for s in best[3]])

    def say(tree, x):
        while not isinstance(tree, int):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    out = {}
    for point in product(*(grid[c] for c in ("class_weight", "criterion", "max_depth", "min_samples_leaf", "min_samples_split"))):
        kind, criterion, limit, leaf, least = point
        scores = []
        for held in sorted({r[0] for r in rows}):
            train = [r for r in rows if r[0] != held]
            fills = []
            for i in (2, 3):
                known = [r[i] for r in train if r[i] is not None]
                fills.append(sum(known) / len(known) if known else 0.0)
            data = [([fills[i] if v is None else v for i, v in enumerate(r[2:])], r[1]) for r in rows]
            group = [d for d, r in zip(data, rows) if r[0] != held]
            n1 = sum(y for _, y in group)
            weight = (max(1, n1), max(1, len(group) - n1)) if kind else (1, 1)
            tree = grow(group, 0, weight, criterion, leaf, limit, least)
            got = [(say(tree, x), y) for (x, y), r in zip(data, rows) if r[0] == held]
            tp = sum(g and y for g, y in got)
            wrong = sum(g != y for g, y in got)
            scores.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
        out[point] = sum(scores) / len(scores)
    return out


@pytest.mark.parametrize("local_cells", [10 ** 6, 40])
def test_grid_equals_plain_trees(spark, local_cells):
    rows = fixture_rows()
    nan = [(k, y, float("nan") if a is None and i % 2 else a, b) for i, (k, y, a, b) in enumerate(rows)]     # NaN is missing, too
    df = spark.createDataFrame(nan, "fold int, y int, a double, b double")
    got = grid_search(df, ["a", "b"], GRID, local_cells=local_cells).collect()
    want = plain_grid(rows, GRID)
    assert [(r.class_weight, r.criterion, r.max_depth, r.min_samples_leaf, r.min_samples_split) for r in sorted(got, key=lambda r: r.place)] == list(want)
    for r, f1 in zip(sorted(got, key=lambda r: r.place), want.values()):
        assert r.f1_mean == pytest.approx(f1, abs=1e-9), r
    top = max(want.values())
    assert [r.place for r in got if r.is_best] == [next(i for i, v in enumerate(want.values(), 1) if v > top - 1e-12)]


def test_one_class_and_equal_rows(spark):
    """Without the class every F1 is 0; with nothing but it, and one feature value, every F1 is 1."""
    for y, f1 in ((0, 0.0), (1, 1.0)):
        df = spark.createDataFrame([(i % 5, y, 1.0, None) for i in range(20)], "fold int, y int, a double, b double")
        got = grid_search(df, ["a", "b"], GRID).collect()
        assert len(got) == 48 and {r.f1_mean for r in got} == {f1}
        assert [r.place for r in got if r.is_best] == [1]


def test_the_searched_sample_is_run_0_and_needs_no_ensemble(spark, monkeypatch):
    """The grid query draws the very rows of run 0 of many runs, without the other runs and their trees."""
    from collections import Counter

    from washline.operators import grid
    from washline.plans import catalog as K
    from washline.plans.ensemble import training_splits

    rng = random.Random(5)
    rows = [(K.ENSEMBLE_STATE if i % 4 else "ASIA", f"s{i}", rng.choice(["Damage", "No Damage", "No Damage", None]), float(i % 7), float(i), None if i % 9 == 0 else i / 2) for i in range(400)]
    seg = spark.createDataFrame(rows, "state string, segment_id string, Damage_Status string, Z_Min double, Distance_to_Coast_m double, Rel_Elev_Min double")
    drawn = training_splits(seg, K.ENSEMBLE_STATE, K._FEATS, 3)[1].where("run = 0 and split = 'train'")

    def unwanted(*_):
        raise AssertionError("the ensemble is not part of the grid search")

    monkeypatch.setattr(K, "_ensemble_parts", unwanted)
    monkeypatch.setattr(K, "segments", lambda *_: seg)
    monkeypatch.setattr(grid, "grid_search", lambda train, features: train)
    got = K.m10_grid_search(spark, "none")
    assert set(got.columns) - {"fold"} == set(drawn.columns)
    assert Counter(map(tuple, got.select(*drawn.columns).collect())) == Counter(map(tuple, drawn.collect())) and drawn.count() > 50
