"""Exact CART growth against a direct Python search; tree-table scoring paths agree."""

import random

import pytest
from pyspark.sql import functions as F

from washline.operators.trees import fit_cart, score_long, score_wide


def _best_split(rows, feats, min_leaf):
    best = None
    n = len(rows)
    P = sum(r[-1] for r in rows)
    N = n - P
    for fi, _ in enumerate(feats):
        vals = sorted({r[fi] for r in rows})
        for a, b in zip(vals, vals[1:]):
            left = [r for r in rows if r[fi] <= a]
            nl = len(left)
            if nl < min_leaf or n - nl < min_leaf:
                continue
            cp = sum(r[-1] for r in left)
            cn = nl - cp
            score = (cp * cp + cn * cn) / nl + ((P - cp) ** 2 + (N - cn) ** 2) / (n - nl)
            key = (score, -fi, -a)
            if best is None or key > best[0]:
                thr = a / 2 + b / 2
                best = (key, fi, thr if thr != b else a)
    return best


def test_root_split_matches_direct_search(spark):
    rnd = random.Random(5)
    feats = ["f0", "f1"]
    rows = [(float(rnd.randint(0, 30)), float(rnd.randint(0, 30)), 0) for _ in range(150)]
    rows = [(a, b, int(a + rnd.randint(-5, 5) > 15)) for a, b, _ in rows]
    df = spark.createDataFrame([(0, a, b, y) for a, b, y in rows], "run int, f0 double, f1 double, y int")
    trees = fit_cart(df, ["run"], feats, "y", max_depth=1, min_leaf=10, n_buckets=8, checkpoint_levels=False)
    root = trees.where("node = 0").first()
    _, fi, thr = _best_split(rows, feats, 10)
    assert root.feature == feats[fi] and root.threshold == pytest.approx(thr)
    leaves = trees.where("is_leaf").collect()
    assert sum(r.n for r in leaves) == 150

    wide, runs = score_wide(df, trees)
    long = score_long(df.withColumn("rid", F.monotonically_increasing_id()), trees, ["rid", "f0", "f1"] and ["rid"], feats)
    assert long.count() == 150 and sorted(r.p for r in long.collect()) == sorted(r.p_0 for r in wide.collect())


def test_wide_scores_of_large_forests(spark, monkeypatch):
    """Above the inline limit trees travel as arrays; both ways and the average over a forest agree."""
    import random
    from washline.operators import trees as TR
    rng = random.Random(0)
    rows = []
    for run in range(6):
        for tree in range(5):
            for node in range(15):
                leaf = node >= 7 or (node == 5 and tree == 2)
                rows.append((run, tree, node, leaf, None if leaf else rng.choice("abc"), None if leaf else rng.uniform(-1, 1), rng.random()))
    forest = spark.createDataFrame([r for r in rows if not (r[1] == 2 and r[2] in (11, 12))],
                                   "run int, tree int, node int, is_leaf boolean, feature string, threshold double, prob double")
    df = spark.createDataFrame([(i, *(None if rng.random() < 0.1 else rng.uniform(-1, 1) for _ in "abc")) for i in range(500)],
                               "id int, a double, b double, c double")
    wide, groups = TR.score_wide(df, forest)
    want = {r.id: r for r in wide.collect()}
    monkeypatch.setattr(TR, "INLINE_NODE_LIMIT", 10)
    for limit in (100, 10_000):
        monkeypatch.setattr(TR, "ARRAY_NODE_LIMIT", limit)
        got, again = TR.score_wide(df, forest)
        assert again == groups == list(range(6)) and got.columns == wide.columns
        for r in got.collect():
            assert all(abs(r[f"p_{g}"] - want[r.id][f"p_{g}"]) < 1e-12 for g in groups)
    one = forest.where("tree = 0").drop("tree")
    a = {r.id: r.p_3 for r in TR.score_wide(df, one)[0].collect()}
    monkeypatch.setattr(TR, "INLINE_NODE_LIMIT", 10_000)
    assert a == {r.id: r.p_3 for r in TR.score_wide(df, one)[0].collect()}


def test_reduced_scores_are_those_of_the_wide_form(spark, monkeypatch):
    """mean, spread and vote in one step equal the reduction of a column per run, to the last bit."""
    import random
    from washline.operators import trees as TR
    from washline.operators.ensemble import reduce_wide
    rng = random.Random(3)
    rows = []
    for run in range(7):
        for node in range(7):
            leaf = node >= 3 or run == 6 and node == 0
            rows.append((run, node, leaf, None if leaf else rng.choice("abc"), None if leaf else rng.choice([-0.5, 0.0, rng.uniform(-1, 1)]), rng.random()))
    trees = spark.createDataFrame([r for r in rows if r[0] < 6 or r[1] == 0], "run int, node int, is_leaf boolean, feature string, threshold double, prob double")
    value = lambda: rng.choice([None, float("nan"), -0.5, 0.0, rng.uniform(-1, 1), rng.uniform(-1, 1)])
    df = spark.createDataFrame([(i, value(), value(), value()) for i in range(300)], "id int, a double, b double, c double")
    wide, groups = TR.score_wide(df, trees)
    names = ["id", "p_mean_raw", "p_std", "p_vote"]
    want = sorted(map(tuple, reduce_wide(wide, [f"p_{g}" for g in groups]).select(names).collect()))
    got = TR.score_reduced(df, trees, 0.5)
    assert got.columns == [*df.columns, *names[1:]]
    assert sorted(map(tuple, got.select(names).collect())) == want
    only = trees.where("run = 6")               # no split at all
    assert {r.p_mean_raw for r in TR.score_reduced(df, only, 0.5).collect()} == {only.first().prob}
    monkeypatch.setattr(TR, "ARRAY_NODE_LIMIT", 3)
    assert sorted(map(tuple, TR.score_reduced(df, trees, 0.5).select(names).collect())) == want
    # cells: the same rows and scores, counted
    marked, features = TR.with_tree_cell(df.withColumn("y", df.id % 2), trees)
    cells = TR.count_cells(marked, ["y"], features)
    assert features == ["a", "b", "c"] and cells.count() < 300
    assert cells.agg({"_rows": "sum"}).first()[0] == 300
    weighted, _ = TR.score_wide(cells, trees)
    for g in groups:
        a = sorted((r[0], round(r[1], 9)) for r in wide.selectExpr("id % 2 as y", f"p_{g} as p").groupBy("y").sum("p").select("y", "sum(p)").collect())
        b = sorted((r[0], round(r[1], 9)) for r in weighted.selectExpr("y", f"p_{g} * _rows as p").groupBy("y").sum("p").select("y", "sum(p)").collect())
        assert a == b


def test_members_grow_the_trees_of_listed_runs(spark):
    """counting packed runs batch by batch gives the trees of ``fit_cart``, with NULL, NaN and pure runs."""
    import random
    from washline.operators.trees import fit_cart_members
    rng = random.Random(8)
    value = lambda: rng.choice([None, float("nan"), *(round(rng.uniform(0, 9), 1) for _ in range(12))])
    rows = [(f"s{i}", i % 3 % 2, value(), value(), [rng.choice([0, 1, 1, 2]) for _ in range(5)] + [int(i % 3 % 2 == 0), 0]) for i in range(500)]
    packed = spark.createDataFrame(rows, "segment_id string, y int, a double, b double, member array<tinyint>").repartition(3)
    runs = spark.createDataFrame([(r, y, a, b) for _, y, a, b, m in rows for r, k in enumerate(m) if k == 1], "run int, y int, a double, b double")
    order = ["run", "node", "depth", "is_leaf", "feature", "threshold", "n", "n_pos", "prob"]
    want = fit_cart(runs, ["run"], ["a", "b"], "y", 3, 5).select(order)
    got = fit_cart_members(packed, 1, ["a", "b"], "y", 3, 5).select(order)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
