"""Grid search of decision trees (M-10): every grid point x fold, scored by the F1 of class 1, in one set of jobs.

Greedy growth does not depend on the largest depth nor on the least rows to split: these two
only say where a row's way down the tree stops. So one tree grows, without a depth limit, for
each (fold, criterion, class weight, least rows a leaf), and every row that the fold holds out
walks it and is counted once for each (depth, least rows to split) with the class of the node where it stops.

Rows with equal features are one cell with class counts. Cells carry their node; there is no tree table:

* a node of more than ``local_cells`` cells is split by a distributed step: class counts per
  (node, feature, value), running totals in split buckets, best cut per node;
* any smaller node is one group of at most ``local_cells`` cells, and its whole subtree grows in one task;
* a large node that cannot be split is summed up before it travels.

Missing values (NULL, NaN) are filled with the mean of the fold's training rows, as in a pipeline fitted per fold.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline import schema as S
from washline.operators.windows import next_value, range_bucket, running_totals, small_side
from washline.session import ship_package

LOCAL_CELLS = 200_000
#: Scores are compared at so many decimals, so that equal splits tie whatever the order of a sum.
DECIMALS = 10
_KEYS = ["held", "variant", "node"]
_COUNTS = "held int, variant int, max_depth int, min_samples_split int, tp long, fp long, fn long"


def variants(grid: dict) -> list[tuple]:
    """(class weight, criterion, least rows a leaf) of the trees to grow."""
    return list(product(grid["class_weight"], grid["criterion"], grid["min_samples_leaf"]))


def grid_search(rows: DataFrame, features: list[str], grid: dict = S.TREE_GRID, folds: int = 5, label: str = "y",
                fold_col: str = "fold", local_cells: int = LOCAL_CELLS) -> DataFrame:
    """(place, the five parameters, f1_mean, is_best), a row per grid point; of equal means the first point is the best.

    ``max_depth`` NULL is unlimited, ``class_weight`` NULL is none. The mean is over the folds that hold rows.
    A node's class is the heavier one, class 0 on a tie; without predicted or true positives F1 is 0.
    """
    from washline.plans.common import materialize

    ship_package(rows.sparkSession)
    xs = [f"x{i}" for i in range(len(features))]
    cells = materialize(rows.select(F.col(fold_col).cast("int").alias("fold"), F.col(label).cast("long").alias("y"),
                                    *[F.when(~F.isnan(v), v).alias(x) for v, x in zip([F.col(f).cast("double") for f in features], xs)])
                        .groupBy("fold", *xs).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")))
    open_ = _roots(cells, xs, variants(grid), folds)
    ready = []
    unlimited = None in grid["max_depth"]
    level = 0
    while True:
        nodes = materialize(open_.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("cells"), F.sum(F.when(F.col("train"), F.col("n")).otherwise(0)).alias("node_n"),
                                                      F.sum(F.when(F.col("train"), F.col("pos")).otherwise(0)).alias("node_pos")))
        large = nodes.where(F.col("cells") > local_cells)
        deep = not unlimited and level >= max(grid["max_depth"])
        if not large.head(1):
            ready.append(open_)
            break
        marked = open_.join(small_side(large), _KEYS, "left")
        ready.append(marked.where("cells is null").select(*open_.columns))
        marked = marked.where("cells is not null")
        best = small_side(_best_splits(marked, xs, grid) if not deep else large.select(*_KEYS, F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("t")).limit(0))
        marked = materialize(marked.join(best, _KEYS, "left"))
        ready.append(_summed(marked.where("f is null"), xs))
        own = F.get(F.array(*xs), F.col("f"))
        heavier = (F.col("node_pos") * F.col("a1") > (F.col("node_n") - F.col("node_pos")) * F.col("a0")).cast("int")
        open_ = materialize(marked.where("f is not null").select(
            "held", "variant", F.concat("node", F.when(own <= F.col("t"), "0").otherwise("1")).alias("node"), "train", "n", "pos", "a0", "a1", *xs,
            F.array_append("ns", F.col("node_n")).alias("ns"), F.array_append("preds", heavier).alias("preds")))
        level += 1
    out = ready[0]
    for part in ready[1:]:
        out = out.unionByName(part)
    counts = out.groupBy(*_KEYS).applyInPandas(_finisher(len(xs), grid), _COUNTS)
    return _summary(counts, grid)


def _roots(cells: DataFrame, xs: list[str], kinds: list[tuple], folds: int) -> DataFrame:
    """Every cell in the root of every (held-out fold, variant), filled with that fold's training means."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda h: h != F.col("fold"))
    sums = cells.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"),
                                     *[F.sum(F.col(x) * F.col("n")).alias(f"s_{x}") for x in xs], *[F.sum(F.when(F.col(x).isNotNull(), F.col("n"))).alias(f"c_{x}") for x in xs])
    # a row per held-out fold
    stats = sums.withColumn("held", F.explode(others)).groupBy("held").agg(
        F.sum("n").alias("_n"), F.sum("pos").alias("_pos"), *[F.coalesce(F.sum(f"s_{x}") / F.sum(f"c_{x}"), F.lit(0.0)).alias(f"m_{x}") for x in xs])
    kind = F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(w == "balanced").alias("balanced")) for i, (w, _, _) in enumerate(kinds)]))
    wide = cells.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("kind", kind)
    wide = wide.join(small_side(stats), "held")

    def weight(of: Column) -> Column:       # balanced: each class weighs as many rows as the other has; a common factor changes no split
        return F.when(F.col("kind.balanced"), F.greatest(F.lit(1), of)).otherwise(F.lit(1)).cast("long")

    return wide.select("held", F.col("kind.variant").alias("variant"), F.lit("").alias("node"), (F.col("fold") != F.col("held")).alias("train"), "n", "pos",
                       weight(F.col("_pos")).alias("a0"), weight(F.col("_n") - F.col("_pos")).alias("a1"),
                       *[F.coalesce(F.col(x), F.col(f"m_{x}")).alias(x) for x in xs],
                       F.array().cast("array<long>").alias("ns"), F.array().cast("array<int>").alias("preds"))


def _summed(marked: DataFrame, xs: list[str]) -> DataFrame:
    """Nodes that stay whole: their training and held-out cells as one row each, without feature values."""
    return marked.groupBy(*_KEYS, "train").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("a0").alias("a0"), F.max("a1").alias("a1"),
        *[F.lit(0.0).alias(x) for x in xs], F.max("ns").alias("ns"), F.max("preds").alias("preds"))


def _best_splits(marked: DataFrame, xs: list[str], grid: dict) -> DataFrame:
    """(node keys, f, t) of the large nodes that can be split."""
    kinds = variants(grid)
    leaf = F.get(F.array(*[F.lit(m) for _, _, m in kinds]), F.col("variant"))
    entropy = F.get(F.array(*[F.lit(c == "entropy") for _, c, _ in kinds]), F.col("variant"))
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(x).alias("v")) for i, x in enumerate(xs)]))
    can = F.col("train") & (F.col("node_pos") > 0) & (F.col("node_pos") < F.col("node_n")) & (F.col("node_n") >= min(grid["min_samples_split"]))
    long = marked.where(can).select(*_KEYS, "n", "pos", "node_n", "node_pos", "a0", "a1", value.alias("s"))
    hist = long.groupBy(*_KEYS, F.col("s.f").alias("f"), F.col("s.v").alias("v")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), *[F.max(c).alias(c) for c in ("node_n", "node_pos", "a0", "a1")])
    from washline.plans.common import materialize
    by = [*_KEYS, "f"]
    hist = materialize(range_bucket(hist, by, "v"))
    cum = next_value(running_totals(hist, by, ["v"], {"ln": "n", "lp": "pos"}, "_bucket"), by, "v", "_bucket", "after")
    rn, rp = F.col("node_n") - F.col("ln"), F.col("node_pos") - F.col("lp")
    cum = cum.where(F.col("after").isNotNull() & (F.col("ln") >= leaf) & (rn >= leaf))

    def side(n: Column, p: Column) -> Column:
        q1, q0 = (p * F.col("a1")).cast("double"), ((n - p) * F.col("a0")).cast("double")
        w = q1 + q0
        told = sum((F.when(q > 0, q * F.log2(q / w)).otherwise(0.0) for q in (q1, q0)), F.lit(0.0))
        return F.when(entropy, told).otherwise((q1 * q1 + q0 * q0) / w)

    whole = (F.col("node_pos") * F.col("a1") + (F.col("node_n") - F.col("node_pos")) * F.col("a0")).cast("double")
    score = F.round((side(F.col("ln"), F.col("lp")) + side(rn, rp)) / whole, DECIMALS)
    mid = F.col("v") / 2 + F.col("after") / 2
    t = F.when(mid == F.col("after"), F.col("v")).otherwise(mid)
    return cum.groupBy(*_KEYS).agg(F.max_by(F.struct("f", t.alias("t")), F.struct(score, -F.col("f"), -F.col("v"))).alias("b")).select(*_KEYS, "b.f", "b.t")


def _scores(n: np.ndarray, p: np.ndarray, a0: int, a1: int, criterion: str) -> np.ndarray:
    q1, q0 = (p * a1).astype(float), ((n - p) * a0).astype(float)
    w = q1 + q0
    if criterion == "gini":
        return (q1 * q1 + q0 * q0) / w
    with np.errstate(divide="ignore", invalid="ignore"):
        return sum(np.where(q > 0, q * np.log2(q / w), 0.0) for q in (q1, q0))


def _cuts(x: np.ndarray, n: np.ndarray, p: np.ndarray, node: np.ndarray, orders: list, N: np.ndarray, P: np.ndarray, a0: int, a1: int, leaf: int, criterion: str):
    """(feature, threshold) of each node's best split; feature -1 where there is none. ``orders`` holds the cells by value, per feature."""
    best, feature, at = np.full(len(N), -np.inf), np.full(len(N), -1), np.zeros(len(N))
    before_n, before_p = np.cumsum(N) - N, np.cumsum(P) - P
    whole = (P * a1 + (N - P) * a0).astype(float)
    for f, o in enumerate(orders):
        o = o[np.argsort(node[o], kind="stable")]
        nd, v = node[o], x[o, f]
        i = np.flatnonzero((nd[1:] == nd[:-1]) & (v[1:] > v[:-1]))
        k = nd[i]
        ln, lp = np.cumsum(n[o])[i] - before_n[k], np.cumsum(p[o])[i] - before_p[k]
        rn, rp = N[k] - ln, P[k] - lp
        ok = (ln >= leaf) & (rn >= leaf)
        i, k, ln, lp, rn, rp = (c[ok] for c in (i, k, ln, lp, rn, rp))
        if not len(i):
            continue
        score = np.round((_scores(ln, lp, a0, a1, criterion) + _scores(rn, rp, a0, a1, criterion)) / whole[k], DECIMALS)
        top = np.lexsort((np.arange(len(k)), -score, k))
        top = top[np.concatenate([[True], k[top][1:] != k[top][:-1]])]      # a node's best cut: highest score, then lowest value
        top = top[score[top] > best[k[top]]]
        low, high = v[i[top]], v[i[top] + 1]
        mid = low / 2 + high / 2
        best[k[top]], feature[k[top]], at[k[top]] = score[top], f, np.where(mid == high, low, mid)
    return feature, at


def _finisher(n_features: int, grid: dict):
    """Grow one node's whole subtree and count the held-out cells where they stop."""
    kinds, points = variants(grid), list(product(grid["max_depth"], grid["min_samples_split"]))
    names = [f"x{i}" for i in range(n_features)]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        _, criterion, leaf = kinds[int(first["variant"])]
        a0, a1, ns, preds = int(first["a0"]), int(first["a1"]), list(first["ns"]), list(first["preds"])
        found = np.zeros((len(points), 3), np.int64)      # tp, fp, fn
        train = group["train"].to_numpy(bool)
        x, n, p = group[names].to_numpy(float), group["n"].to_numpy(np.int64), group["pos"].to_numpy(np.int64)
        hx, hn, hp = x[~train], n[~train], p[~train]
        x, n, p = x[train], n[train], p[train]

        def count(i, says, cells):
            says = np.broadcast_to(says, cells.shape)
            found[i] += [hp[cells][says].sum(), (hn - hp)[cells][says].sum(), hp[cells][~says].sum()]

        going = np.zeros(len(points), bool)               # points whose way has not stopped above this node
        everything = np.arange(len(hn))
        for i, (depth, least) in enumerate(points):
            stop = next((k for k, rows in enumerate(ns) if k == depth or rows < least), None)
            if stop is None:
                going[i] = True
            else:
                count(i, bool(preds[stop]), everything)
        level, node, hnode, cells = len(ns), np.zeros(len(n), np.int64), np.zeros(len(hn), np.int64), everything
        live = np.tile(going, (1, 1))                     # (nodes, points)
        while len(cells) and live.any():
            m = len(live)
            N, P = (np.bincount(node, c, m).astype(np.int64) for c in (n, p))
            says = P * a1 > (N - P) * a0
            feature, at = _cuts(x, n, p, node, [np.argsort(x[:, f], kind="stable") for f in range(n_features)], N, P, a0, a1, leaf, criterion)
            feature[(P == 0) | (P == N)] = -1
            for i, (depth, least) in enumerate(points):
                ends = live[:, i] & ((feature < 0) | (N < least) | (level == depth))
                hit = ends[hnode]
                count(i, says[hnode[hit]], cells[hit])
                live[ends, i] = False
            # on with the nodes that some point walks through and that hold held-out cells
            has = np.zeros(m, bool)
            has[hnode] = True
            on = live.any(1) & has
            number = np.cumsum(on) - 1

            def down(of, values):
                keep = on[of]  # noqa: B023
                k = of[keep]
                right = values[keep][np.arange(len(k)), feature[k]] > at[k]  # noqa: B023
                return keep, 2 * number[k] + right  # noqa: B023

            keep, node = down(node, x)
            x, n, p = x[keep], n[keep], p[keep]
            keep, hnode = down(hnode, hx[cells])
            cells = cells[keep]
            live = np.repeat(live[on], 2, axis=0)
            level += 1
        return pd.DataFrame({"held": int(first["held"]), "variant": int(first["variant"]), "max_depth": pd.array([d for d, _ in points], "Int32"),
                             "min_samples_split": [s for _, s in points], "tp": found[:, 0], "fp": found[:, 1], "fn": found[:, 2]})

    return finish


def _summary(counts: DataFrame, grid: dict) -> DataFrame:
    sums = counts.groupBy("held", "variant", "max_depth", "min_samples_split").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.lit(1).alias("one"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    mean = sums.groupBy("variant", "max_depth", "min_samples_split").agg(F.avg(f1).alias("f1_mean"))
    kinds = F.array(*[F.struct(F.lit(w).cast("string").alias("class_weight"), F.lit(c).alias("criterion"), F.lit(m).alias("min_samples_leaf")) for w, c, m in variants(grid)])
    depths = F.array(*[F.lit(d).cast("int") for d in grid["max_depth"]])
    order = [F.floor(F.col("variant") / len(grid["min_samples_leaf"])), F.array_position(F.transform(depths, lambda d: F.coalesce(d, F.lit(-1))), F.coalesce("max_depth", F.lit(-1))),
             F.pmod("variant", F.lit(len(grid["min_samples_leaf"]))), F.array_position(F.array(*[F.lit(s) for s in grid["min_samples_split"]]), F.col("min_samples_split"))]
    one = Window.partitionBy(F.lit(1))          # as many rows as the grid has points
    out = mean.withColumn("k", F.get(kinds, F.col("variant"))).withColumn("place", F.row_number().over(one.orderBy(*order)))
    first = F.row_number().over(one.orderBy(F.col("f1_mean").desc(), "place"))
    return out.select("place", "k.class_weight", "k.criterion", "max_depth", "k.min_samples_leaf", "min_samples_split", "f1_mean", (first == 1).alias("is_best"))
