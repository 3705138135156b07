"""Decision trees as data: exact CART growth and tree-table scoring (M-3 exact, M-8, J-5).

Trees are rows of a node table ``(keys..., node, depth, is_leaf, feature,
threshold, n, n_pos, prob)``; node ``k`` has children ``2k+1`` (value <=
threshold) and ``2k+2``. Growing a level is one set of grouped aggregations
over all groups at once (every run's tree grows in the same job); scoring
compiles a bounded tree table into Column expressions, or walks it with
broadcast equi-joins when it is too large to inline.

Split rule (CART, gini): candidate thresholds lie between consecutive distinct
values (midpoint); both children must hold at least ``min_leaf`` rows; pure
nodes and nodes at ``max_depth`` are leaves. Among equal scores the lower
feature index and then the lower threshold win (deterministic).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.operators.windows import DEFAULT_BUCKETS, _join_keys, next_value, range_bucket, running_totals, small_side
from washline.session import ship_package

NODE_COLUMNS = ["node", "depth", "is_leaf", "feature", "threshold", "n", "n_pos", "prob"]
INLINE_NODE_LIMIT = 5000
ARRAY_NODE_LIMIT = 1_000_000


def _best_splits(cur: DataFrame, keys: list[str], features: list[str], label: str, min_leaf: int,
                 n_buckets: int) -> DataFrame:
    """Best (feature, threshold) per (keys, node) among valid splits."""
    k_node = [*keys, "node"]
    long = cur.select(*k_node, F.col(label).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("fi"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("_fv"))
    long = long.select(*k_node, "_y", F.col("_fv.fi").alias("fi"), F.col("_fv.v").alias("v")).where(F.col("v").isNotNull())
    vc = long.groupBy(*k_node, "fi", "v").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    return _splits_of_counts(vc, k_node, min_leaf, n_buckets)


def _splits_of_counts(vc: DataFrame, k_node: list[str], min_leaf: int, n_buckets: int) -> DataFrame:
    """``_best_splits`` from the class counts ``vc(k_node, fi, v, pos, neg)`` of every distinct value."""
    from washline.plans.common import materialize

    vc = materialize(vc)
    gk = [*k_node, "fi"]
    b = range_bucket(vc, gk, "v", n_buckets)
    cum = running_totals(b, gk, ["v"], {"cp": "pos", "cn": "neg"}, "_bucket")
    cum = next_value(cum, gk, "v", "_bucket", "v_next")
    tot = vc.groupBy(*gk).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cand = _join_keys(cum, small_side(tot), gk)
    nl = F.col("cp") + F.col("cn")
    nr = F.col("P") + F.col("N") - nl
    cp, cn = F.col("cp").cast("double"), F.col("cn").cast("double")
    rp, rn = (F.col("P") - F.col("cp")).cast("double"), (F.col("N") - F.col("cn")).cast("double")
    score = (cp * cp + cn * cn) / nl.cast("double") + (rp * rp + rn * rn) / nr.cast("double")
    valid = cand.where((nl >= min_leaf) & (nr >= min_leaf) & F.col("v_next").isNotNull())
    mid = F.col("v") / 2.0 + F.col("v_next") / 2.0
    valid = valid.select(*k_node, "fi", "v", F.when(mid == F.col("v_next"), F.col("v")).otherwise(mid).alias("thr"),
                         score.alias("score"))
    top = F.max(F.struct(F.col("score").alias("s"), (-F.col("fi")).alias("nfi"), (-F.col("v")).alias("nv"),
                         F.col("thr").alias("thr")))
    best = valid.groupBy(*k_node).agg(top.alias("b"))
    return best.select(*k_node, (-F.col("b.nfi")).cast("int").alias("fi"), F.col("b.thr").alias("threshold"))


def fit_cart(train: DataFrame, keys: list[str], features: list[str], label: str = "y",
             max_depth: int = 2, min_leaf: int = 10, n_buckets: int = DEFAULT_BUCKETS,
             checkpoint_levels: bool = True) -> DataFrame:
    """Grow one exact CART tree per ``keys`` group (e.g. per run) with gini impurity."""
    cur = train.select(*keys, F.col(label).cast("int").alias(label), *features).withColumn("node", F.lit(0))
    levels = []
    for depth in range(max_depth + 1):
        stats = cur.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if(F.col(label) == 1).alias("n_pos"))
        stats = small_side(stats)          # one row per (group, node): broadcast, training rows stay put
        if depth < max_depth:
            best = _best_splits(_join_keys(cur, _splittable(stats, min_leaf).select(*keys, "node"), [*keys, "node"]),
                                keys, features, label, min_leaf, n_buckets)
            best = _named(best, features)
            best = small_side(best) if checkpoint_levels else best
        else:
            best = _no_splits(stats, keys)
        levels.append(_level(stats, best, keys, depth))
        if depth == max_depth:
            break
        value = F.element_at(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]), F.col("feature"))
        nxt = _join_keys(cur, best, [*keys, "node"])
        cur = nxt.select(*keys, label, *features, F.when(value <= F.col("threshold"), 2 * F.col("node") + 1)
                         .otherwise(2 * F.col("node") + 2).alias("node"))
    return reduce(DataFrame.unionByName, levels)


def _splittable(stats: DataFrame, min_leaf: int) -> DataFrame:
    return stats.where((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n")) & (F.col("n") >= 2 * min_leaf))


def _named(best: DataFrame, features: list[str]) -> DataFrame:
    return best.withColumn("feature", F.element_at(F.array(*[F.lit(f) for f in features]), F.col("fi") + 1)).drop("fi")


def _no_splits(stats: DataFrame, keys: list[str]) -> DataFrame:
    return stats.limit(0).select(*keys, "node", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("threshold"))


def _level(stats: DataFrame, best: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """The node rows of one level."""
    level = _join_keys(stats, best, [*keys, "node"], "left")
    return level.select(*keys, "node", F.lit(depth).alias("depth"), F.col("feature").isNull().alias("is_leaf"),
                        "feature", "threshold", F.col("n").cast("bigint").alias("n"),
                        F.col("n_pos").cast("bigint").alias("n_pos"),
                        (F.col("n_pos") / F.col("n")).alias("prob"))


def fit_cart_members(packed: DataFrame, part: int, features: list[str], label: str = "y", max_depth: int = 2, min_leaf: int = 10,
                     n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``fit_cart`` by run of ``sampling.packed_runs``, on the rows whose ``member`` is ``part``.

    Rows are not listed run by run: every level is one pass that counts the classes per (run, node) and per
    (run, node, feature, value) of whole batches of rows.
    """
    rows = packed.select(F.col(label).cast("int").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "member")
    ship_package(packed.sparkSession)
    levels, known = [], []
    for depth in range(max_depth + 1):
        counts = _member_counts(rows, part, len(features), known, depth < max_depth)
        from washline.plans.common import materialize
        counts = materialize(counts.groupBy("run", "node", "fi", "v").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("n").alias("n")))
        stats = small_side(counts.where("fi < 0").select("run", F.col("node").cast("int").alias("node"), "n", F.col("pos").alias("n_pos")))
        if depth < max_depth:
            vc = _join_keys(counts.where("fi >= 0 and v is not null").select("run", F.col("node").cast("int").alias("node"), "fi", "v", "pos", "neg"),
                            _splittable(stats, min_leaf).select("run", "node"), ["run", "node"])
            best = small_side(_named(_splits_of_counts(vc, ["run", "node"], min_leaf, n_buckets), features))
        else:
            best = _no_splits(stats, ["run"])
        levels.append(_level(stats, best, ["run"], depth))
        if depth == max_depth:
            break
        known.append({(r.run, r.node): (features.index(r.feature), r.threshold) for r in best.collect()})       # at most runs x nodes
    return reduce(DataFrame.unionByName, levels)


def _member_counts(rows: DataFrame, part: int, n_features: int, known: list, by_value: bool) -> DataFrame:
    """(run, node, fi, v, pos, neg, n) of each batch: the classes of every value of every feature, and (``fi`` -1) of all rows, in the
    nodes that the splits ``known`` of the levels above lead to. Rows of a node that did not split are counted no more."""
    model = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        splits = model.value
        for b in batches:
            y = b.column("y").fill_null(-1).to_numpy(zero_copy_only=False)
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, n_features)
            member = b.column("member").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            null = np.asarray(b.column("x").flatten().is_null()).reshape(b.num_rows, n_features)
            cls = np.where(y == 1, 0, np.where(y == 0, 1, 2))
            values = [np.unique(x[~null[:, f], f], return_inverse=True) for f in range(n_features)]
            codes, keys = [], []
            for f, (v, back) in enumerate(values):
                code = np.full(b.num_rows, len(v), np.int64)        # NULL has no value
                code[~null[:, f]] = back
                codes.append(code)
                keys.append(code * 3 + cls)
            found = []
            for r in range(member.shape[1]):
                at = np.flatnonzero(member[:, r] == part)
                if not len(at):
                    continue
                node, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for level in splits:
                    nxt = node.copy()
                    for k in np.unique(node[alive]).tolist():
                        own = alive & (node == k)
                        split = level.get((r, k))
                        if split is None:
                            alive &= ~own
                        else:
                            v = x[at, split[0]]
                            left = ~null[at, split[0]] & (v <= split[1])
                            nxt = np.where(own, np.where(left, 2 * k + 1, 2 * k + 2), nxt)
                    node = nxt
                for k in np.unique(node[alive]).tolist():
                    own = at[alive & (node == k)]
                    n = np.bincount(cls[own], minlength=3)
                    found.append((np.full(1, r), np.full(1, k), np.full(1, -1), np.zeros(1), n[None, :]))
                    for f in range(n_features if by_value else 0):
                        v = values[f][0]
                        c = np.bincount(keys[f][own], minlength=3 * (len(v) + 1)).reshape(-1, 3)[:len(v)]
                        some = np.flatnonzero(c.any(1))
                        found.append((np.full(len(some), r), np.full(len(some), k), np.full(len(some), f), v[some], c[some]))
            if not found:
                continue
            r, k, f, v, c = (np.concatenate(z) for z in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(k, pa.int64()), pa.array(f, pa.int32()), pa.array(v), pa.array(c[:, 0], pa.int64()),
                                              pa.array(c[:, 1], pa.int64()), pa.array(c.sum(1), pa.int64())], names=["run", "node", "fi", "v", "pos", "neg", "n"])

    return rows.mapInArrow(run, "run int, node long, fi int, v double, pos long, neg long, n long")


# --- scoring ---------------------------------------------------------------------

def compile_tree(nodes: list[dict]) -> Column:
    """Nested ``when`` expression of one tree given its node rows (as dicts)."""
    by_id = {int(r["node"]): r for r in nodes}

    def build(k: int) -> Column:
        r = by_id[k]
        if r["is_leaf"]:
            return F.lit(float(r["prob"]))
        return F.when(F.col(r["feature"]) <= F.lit(float(r["threshold"])), build(2 * k + 1)).otherwise(build(2 * k + 2))
    return build(0)


def score_wide(df: DataFrame, trees: DataFrame, group: str = "run", prefix: str = "p_",
               inline_limit: int | None = None) -> tuple[DataFrame, list]:
    """Add one probability column per tree group (map-only: no shuffle of the scored rows).

    A group is one tree, or a forest when ``trees`` has a ``tree`` column (the mean
    over its trees). Small tables become Column expressions; larger ones travel as
    broadcast arrays, ``ARRAY_NODE_LIMIT`` nodes at a time, and whole batches of rows
    walk all their trees at once. Both give the same columns. A NULL feature goes right.
    """
    rows = [r.asDict() for r in trees.select(group, *(["tree"] if "tree" in trees.columns else []), "node", "is_leaf",
                                             "feature", "threshold", "prob").collect()]
    forests: dict = {}
    for r in rows:
        forests.setdefault(r[group], {}).setdefault(r.get("tree"), []).append(r)
    groups = sorted(forests)
    if len(rows) <= (INLINE_NODE_LIMIT if inline_limit is None else inline_limit):
        cols = [reduce(lambda x, y: x + y, [compile_tree(t) for t in forests[g].values()]) / F.lit(float(len(forests[g]))) for g in groups]
        return df.select("*", *[c.alias(f"{prefix}{g}") for c, g in zip(cols, groups)]), groups
    out, block, size = df, [], 0
    for g in groups:
        block.append(g)
        size += sum(len(t) for t in forests[g].values())
        if size >= ARRAY_NODE_LIMIT or g == groups[-1]:
            out = _score_arrays(out, {x: list(forests[x].values()) for x in block}, prefix)
            block, size = [], 0
    return out, groups


def _score_arrays(df: DataFrame, forests: dict, prefix: str) -> DataFrame:
    """Columns ``prefix<group>``: every row walks the dense node arrays of all trees of the block."""
    from pyspark.sql import types as T

    features = sorted({r["feature"] for f in forests.values() for t in f for r in t if r["feature"] is not None})
    at = {f: i for i, f in enumerate(features)}
    all_trees = [t for f in forests.values() for t in f]
    width = max(int(r["node"]) for t in all_trees for r in t) + 1
    feature = np.full((len(all_trees), width), -1, np.int32)
    threshold, prob = np.zeros(feature.shape), np.zeros(feature.shape)
    for k, t in enumerate(all_trees):
        for r in t:
            n = int(r["node"])
            prob[k, n] = r["prob"]
            if not r["is_leaf"]:
                feature[k, n], threshold[k, n] = at[r["feature"]], r["threshold"]
    depth = width.bit_length()
    cuts = np.cumsum([0, *(len(f) for f in forests.values())])[:-1]
    counts = np.array([len(f) for f in forests.values()], float)
    names = [f"{prefix}{g}" for g in forests]
    model = df.sparkSession.sparkContext.broadcast((feature, threshold, prob))

    def run(batches):
        feature, threshold, prob = model.value
        trees = np.arange(len(feature))
        step = max(1, 2_000_000 // len(feature))
        for b in batches:
            x = np.stack([np.asarray(b.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for f in features], 1) \
                if features else np.zeros((b.num_rows, 1))
            parts = []
            for lo in range(0, b.num_rows, step):
                part = x[lo:lo + step]
                node = np.zeros((len(part), len(feature)), np.int64)
                for _ in range(depth):
                    f = feature[trees, node]
                    left = np.take_along_axis(part, np.maximum(f, 0), axis=1) <= threshold[trees, node]
                    node = np.where(f < 0, node, np.where(left, 2 * node + 1, 2 * node + 2))
                parts.append(np.add.reduceat(prob[trees, node], cuts, axis=1) / counts)
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(names)))], names=[*b.schema.names, *names])

    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return df.mapInArrow(run, schema)


def _dense_trees(forests: dict) -> tuple:
    """All trees as dense arrays over codes: features, sorted thresholds of each, (feature, code, prob) by tree and node, trees per group.

    A row's code on a feature is the number of thresholds below its value, so ``value <= threshold`` is a comparison of codes.
    """
    all_trees = [t for f in forests.values() for t in f.values()]
    inner = [r for t in all_trees for r in t if not r["is_leaf"]]
    features = sorted({r["feature"] for r in inner})
    cuts = [np.array(sorted({float(r["threshold"]) for r in inner if r["feature"] == f})) for f in features]
    width = max(int(r["node"]) for t in all_trees for r in t) + 1
    feature = np.full((len(all_trees), width), -1, np.int32)
    code, prob = np.zeros(feature.shape, np.int32), np.zeros(feature.shape)
    for k, t in enumerate(all_trees):
        for r in t:
            n = int(r["node"])
            if r["is_leaf"]:
                prob[k, n] = r["prob"]
            else:
                i = features.index(r["feature"])
                feature[k, n], code[k, n] = i, np.searchsorted(cuts[i], float(r["threshold"]))
    return features, cuts, feature, code, prob, [len(f) for f in forests.values()]


def _codes_of(columns, cuts: list):
    """(rows, features) codes; NULL and NaN lie above every threshold, as they go right."""
    x = [np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in columns]
    return np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x)], 1) if cuts else np.zeros((len(x[0]), 0), np.int64)


def _one_number(codes, cuts: list):
    """One whole number per row that tells rows with different codes apart; NULL if there are too many codes for 63 bits."""
    total, out = 1, np.zeros(len(codes), np.int64)
    for i, c in enumerate(cuts):
        total *= len(c) + 1
        out = out * (len(c) + 1) + codes[:, i]
    return out if total < 1 << 62 else None


def _collected(trees: DataFrame, group: str) -> dict:
    """The node rows by group (ascending) and tree."""
    rows = trees.select(group, *(["tree"] if "tree" in trees.columns else []), "node", "is_leaf", "feature", "threshold", "prob").collect()
    forests: dict = {}
    for r in sorted((r.asDict() for r in rows), key=lambda r: r[group]):
        forests.setdefault(r[group], {}).setdefault(r.get("tree"), []).append(r)
    return forests


def score_reduced(df: DataFrame, trees: DataFrame, threshold: float, mean: str = "p_mean_raw", std: str = "p_std", vote: str = "p_vote",
                  group: str = "run") -> DataFrame:
    """``score_wide`` and ``ensemble.reduce_wide`` in one step: mean, population std and vote share (strict >) over the groups.

    No probability column per group leaves a batch. Rows of a batch that no threshold of any tree tells apart are
    walked once. Sums run over the groups in ascending order, as the wide form adds its columns.
    """
    forests = _collected(trees, group)
    if sum(len(t) for f in forests.values() for t in f.values()) > ARRAY_NODE_LIMIT:
        from washline.operators.ensemble import reduce_wide
        wide, groups = score_wide(df, trees, group)
        cols = [f"p_{g}" for g in groups]
        return reduce_wide(wide, cols, threshold, mean, std, vote).drop(*cols)
    features, *arrays = _dense_trees(forests)
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(arrays)

    def reduced(*columns: pa.Array) -> pa.Array:
        cuts, feature, code, prob, sizes = model.value
        codes = _codes_of(columns, cuts)
        key = _one_number(codes, cuts)
        if key is None:
            back = np.arange(len(codes))
        else:
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            codes = codes[at]
        found = [np.zeros(len(codes)) for _ in range(3)]
        step = max(1, 2_000_000 // len(feature))
        for lo in range(0, len(codes), step):
            part = codes[lo:lo + step]
            node, k = np.zeros((len(part), len(feature)), np.int64), np.arange(len(feature))
            for _ in range(feature.shape[1].bit_length() if cuts else 0):
                f = feature[k, node]
                left = np.take_along_axis(part, np.maximum(f, 0), axis=1) <= code[k, node]
                node = np.where(f < 0, node, np.where(left, 2 * node + 1, 2 * node + 2))
            leaf, p, begin = prob[k, node], [], 0
            for n in sizes:
                p.append(sum(leaf[:, begin + i] for i in range(n)) / float(n))
                begin += n
            m = sum(p) / float(len(p))
            for out, v in zip(found, (m, np.sqrt(sum((x - m) * (x - m) for x in p) / float(len(p))), sum((x > threshold).astype(float) for x in p) / float(len(p)))):
                out[lo:lo + step] = v
        return pa.StructArray.from_arrays([pa.array(v[back]) for v in found], names=["m", "s", "v"])

    udf = F.arrow_udf(reduced, "struct<m: double, s: double, v: double>")
    out = df.withColumn("_reduced", udf(*([F.col(f).cast("double") for f in features] or [F.lit(0.0)])))
    return out.withColumns({mean: F.col("_reduced.m"), std: F.col("_reduced.s"), vote: F.col("_reduced.v")}).drop("_reduced")


def with_tree_cell(df: DataFrame, trees: DataFrame, group: str = "run") -> tuple[DataFrame, list[str]]:
    """``df`` with ``_cell``, equal for rows that no threshold of any tree tells apart; and the features the trees read."""
    features, cuts, *_ = _dense_trees(_collected(trees, group))
    if not features:
        return df.withColumn("_cell", F.array().cast("array<int>")), features
    ship_package(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(cuts)

    def cells(*columns: pa.Array) -> pa.Array:
        codes = _codes_of(columns, model.value)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))

    return df.withColumn("_cell", F.arrow_udf(cells, "array<int>")(*[F.col(f).cast("double") for f in features])), features


def count_cells(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, features, ``_rows``): one row of features for each ``_cell`` of each key, and how many rows it stands for.

    Every tree gives all rows of a cell the same probability, so what depends on (keys, probabilities)
    alone can be worked out on cells in place of rows. With as many cells as rows this only costs the grouping.
    """
    return df.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"), *[F.max(f).alias(f) for f in features]).drop("_cell")


def score_own(df: DataFrame, trees: DataFrame, keep: list[str], features: list[str], group: str = "run") -> DataFrame:
    """Every row scored by the one tree of its own ``group`` (e.g. a run's test split): an equi-join on (group, node) per level."""
    internal = small_side(trees.where(~F.col("is_leaf")).select(group, "node", "feature", "threshold"))
    leaves = small_side(trees.where(F.col("is_leaf")).select(group, "node", "prob"))
    fmap = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    cur = df.select(group, *keep, *features).withColumn("node", F.lit(0))
    for _ in range(trees.agg(F.max("depth")).first()[0] or 0):
        step = F.when(F.col("feature").isNull(), F.col("node")).when(
            F.element_at(fmap, F.col("feature")) <= F.col("threshold"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        cur = cur.join(internal, [group, "node"], "left").select(group, *keep, *features, step.alias("node"))
    return cur.join(leaves, [group, "node"]).select(group, *keep, F.col("prob").alias("p"))


def score_long(df: DataFrame, trees: DataFrame, keep: list[str], features: list[str], group: str = "run") -> DataFrame:
    """J-5 + M-8 for any tree-table size: every row x every tree group, walked by equi-joins.

    Rows fan out over the groups (a generator over the group ids), then each
    level joins the internal-node table on (group, node); that table is
    broadcast only when its row count is within the inline limit.
    """
    gids = [r[0] for r in trees.select(group).distinct().collect()]
    internal = trees.where(~F.col("is_leaf")).select(group, "node", "feature", "threshold")
    leaves = trees.where(F.col("is_leaf")).select(group, "node", "prob")
    if trees.count() <= INLINE_NODE_LIMIT:
        internal, leaves = F.broadcast(internal), F.broadcast(leaves)
    fmap = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])
    cur = df.select(*keep, *features).withColumn(group, F.explode(F.array(*[F.lit(g) for g in gids]))) \
        .withColumn("node", F.lit(0))
    max_depth = trees.agg(F.max("depth")).first()[0] or 0
    for _ in range(max_depth):
        j = cur.join(internal, [group, "node"], "left")
        step = F.when(F.col("feature").isNull(), F.col("node")).when(
            F.element_at(fmap, F.col("feature")) <= F.col("threshold"), 2 * F.col("node") + 1).otherwise(2 * F.col("node") + 2)
        cur = j.select(*keep, *features, group, step.alias("node"))
    return cur.join(leaves, [group, "node"], "left").select(*keep, group, F.col("prob").alias("p"))
