"""Exact split sizes, disjointness and completeness."""

from pyspark.sql import functions as F

from washline.operators.sampling import (balanced_runs, bounded_sample, class_quotas, exact_split, holdout_split, run_splits,
                                         stratified_folds, stratified_split)


def _me_like(spark):
    # 660 rows, 110 damage / 550 no damage (the published training table sizes)
    return spark.range(660).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("segment_id"),
                                   F.lit("ME").alias("state"), (F.col("id") < 110).cast("int").alias("y"))


def test_holdout_and_run_sizes(spark):
    df = _me_like(spark)
    q = {r.y: (r.n_train, r.n_test) for r in class_quotas(df, ["state"], "y", 0.1).collect()}
    assert q == {1: (99, 11), 0: (495, 55)}
    split = holdout_split(df, ["state"])
    counts = {(r.split, r.y): r["count"] for r in split.groupBy("split", "y").count().collect()}
    assert counts == {("holdout", 1): 11, ("holdout", 0): 55, ("pool", 1): 99, ("pool", 0): 495}
    pool = split.where("split = 'pool'").drop("split")
    bal = balanced_runs(pool, ["state"], 3)
    per_run = {(r.run, r.y): r["count"] for r in bal.groupBy("run", "y").count().collect()}
    assert all(per_run[(run, c)] == 99 for run in range(3) for c in (0, 1))
    # different runs draw different negatives, each without replacement
    assert bal.groupBy("run", "segment_id").count().where("count > 1").count() == 0
    s = run_splits(bal, ["state"])
    sizes = {(r.split, r.y): r["count"] // 3 for r in s.groupBy("split", "y").count().collect()}
    assert sizes[("test", 0)] + sizes[("test", 1)] == 40 and sizes[("train", 0)] + sizes[("train", 1)] == 158
    assert s.count() == bal.count()


def test_folds_are_balanced_and_complete(spark):
    df = _me_like(spark)
    f = stratified_folds(df, ["state"], 5)
    assert f.count() == 660
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sorted(sizes) == [132] * 5


def test_first_n_on_a_hot_group_matches_sorting(spark):
    """One group holds almost every row; groups smaller than the quota keep all rows."""
    import hashlib

    from washline.operators.sampling import first_n, first_n_flag, md5_key
    rows = [("hot", f"h{i}") for i in range(5000)] + [("small", f"s{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "g string, segment_id string").withColumn(
        "q", F.when(F.col("g") == "hot", F.lit(1234)).otherwise(F.lit(10))).withColumn("_mk", md5_key("segment_id", 7))
    got = {(r.g, r.segment_id) for r in first_n(df, ["g"], "_mk", "q").collect()}
    want = set()
    for g, quota in (("hot", 1234), ("small", 10)):
        ids = sorted((hashlib.md5(f"{s}|7".encode()).hexdigest(), s) for gg, s in rows if gg == g)
        want |= {(g, s) for _, s in ids[:quota]}
    assert got == want
    flags = first_n_flag(df, ["g"], "_mk", "q", "sel")
    assert flags.count() == len(rows) and {(r.g, r.segment_id) for r in flags.where("sel").collect()} == want


def test_unstratified_exact_split(spark):
    """D-4: ceil(frac * n) test rows per group, classes not balanced on purpose."""
    from washline.operators.sampling import exact_split
    df = _me_like(spark)
    s = exact_split(df, ["state"], "segment_id", 0.3, 42)
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"test": 198, "train": 462}
    again = exact_split(df, ["state"], "segment_id", 0.3, 42)
    assert s.where("split = 'test'").select("segment_id").subtract(again.where("split = 'test'").select("segment_id")).count() == 0


def _classes(spark, *sizes, state="S"):
    rows = [(f"{state}{c}-{i}", state, c) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "segment_id string, state string, y int")


def test_tiny_classes_keep_their_quota(spark):
    for sizes, frac, want in (((18, 2), 0.1, {0: 2}), ((9, 1), 0.1, {0: 1}), ((2, 2), 0.2, {0: 1}), ((1,), 0.1, {0: 1})):
        df = _classes(spark, *sizes)
        got = {r.y: r["count"] for r in stratified_split(df, ["state"], "y", "segment_id", frac, 42).where("split = 'test'").groupBy("y").count().collect()}
        quotas = {r.y: r.n_test for r in class_quotas(df, ["state"], "y", frac).collect() if r.n_test}
        assert got == quotas and sum(got.values()) == -(-frac * sum(sizes) // 1), (sizes, got)
        if len(sizes) == 2 and sizes[0] != sizes[1]:
            assert got == want


def test_null_groups_and_edge_quotas(spark):
    df = _classes(spark, 60, 40, state="A").unionByName(_classes(spark, 60, 40, state="B").withColumn("state", F.lit(None).cast("string")))
    flags = exact_split(df, ["state"], "segment_id", 0.2, 1).where("split = 'test'").groupBy("state").count().collect()
    assert {r.state: r["count"] for r in flags} == {"A": 20, None: 20}
    for k, n in ((0, 0), (5, 10), (100, 200), (1000, 200), (-3, 0)):
        assert bounded_sample(df, ["state"], k).count() == n
    assert bounded_sample(df, [], 7).count() == 7
    pool = stratified_split(df, ["state"], "y", "segment_id", 0.1, 42)
    assert {r.state: r["count"] for r in pool.where("split = 'test'").groupBy("state").count().collect()} == {"A": 10, None: 10}
    runs = balanced_runs(df, ["state"], 2)
    assert {(r.state, r.run, r.y): r["count"] for r in runs.groupBy("state", "run", "y").count().collect()} == {
        (s, k, y): 40 for s in ("A", None) for k in (0, 1) for y in (0, 1)}


def test_first_n_computes_every_md5_once_and_exactly(spark, tmp_path):
    """Odd cases of the cut: equal ids around it, far more equal ids than even spreading allows, quotas of 0, NULL, and all."""
    from pyspark.sql import functions as F
    from washline.operators.sampling import first_n, first_n_flag, md5_key

    rows = [("even", i, 40) for i in range(100)] + [("same", i // 30, 45) for i in range(90)] + [("none", i, 0) for i in range(5)]
    rows += [("all", i, 9) for i in range(7)] + [(None, i, 2) for i in range(4)] + [("null", i, None) for i in range(3)]
    rows += [("lump", 1 if i < 9000 else i, 8000) for i in range(9500)]
    df = spark.createDataFrame(rows, "g string, segment_id int, q int").withColumn("_mk", md5_key("segment_id", 5))
    want = {"even": 40, "same": 45, "all": 7, None: 2, "lump": 8000}
    order = {(r.g, r.segment_id): r._mk for r in df.distinct().collect()}
    picked = first_n(df, ["g"], "_mk", "q").collect()
    assert {g: sum(r.g == g for r in picked) for g in {r.g for r in picked}} == want
    flagged = first_n_flag(df, ["g"], "_mk", "q", "f").collect()
    assert len(flagged) == len(rows)
    for g, n in want.items():
        keys = sorted(order[g, i] for h, i, _ in rows if h == g)
        assert sorted(order[g, r.segment_id] for r in picked if r.g == g) == keys[:n]
        assert sorted(order[g, r.segment_id] for r in flagged if r.g == g and r.f) == keys[:n]
    # rows are not shuffled for it: the selection reads back what one pass over the md5s wrote
    plan = first_n_flag(df.where("g = 'even'").withColumn("q", F.lit(3)), ["g"], "_mk", "q")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "Window" not in plan


def test_packed_runs_are_the_run_splits(spark):
    """All runs as one row per pool row: the same draws, also with repeated ids, NULL groups and one class only."""
    from collections import Counter
    from washline.operators.sampling import packed_runs, unpacked

    rows = [("A", f"s{i}", int(i % 3 == 0)) for i in range(600)] + [(None, f"n{i}", int(i % 4 != 0)) for i in range(80)]
    rows += [("few", f"f{i}", int(i > 2)) for i in range(9)] + [("no", f"q{i}", 0) for i in range(6)] + [("yes", f"y{i}", 1) for i in range(6)]
    rows += [("twice", f"t{i // 2}", int(i // 2 % 3 == 0)) for i in range(300)] + [("lump", "same" if i < 3000 else f"l{i}", int(i % 50 == 0)) for i in range(4000)]
    pool = spark.createDataFrame(rows, "state string, segment_id string, y int")
    names = ["state", "segment_id", "y", "run", "split"]
    want = Counter(map(tuple, run_splits(balanced_runs(pool, ["state"], 4), ["state"]).select(names).collect()))
    packed = packed_runs(pool, ["state"], 4)
    got = Counter(map(tuple, unpacked(packed).select(names).collect()))
    assert packed.count() <= len(rows)
    exact = {None, "A", "few", "no", "yes"}       # where equal ids straddle a cut, any of them may be taken
    assert {k: n for k, n in got.items() if k[0] in exact} == {k: n for k, n in want.items() if k[0] in exact}
    ids = lambda c: Counter({(s, i, run, split): 0 for s, i, _, run, split in c}) + sum((Counter({(s, i, run, split): n}) for (s, i, y, run, split), n in c.items() if s == "twice"), Counter())
    assert ids(got) == ids(want)
    sizes = lambda c: sum((Counter({(s, y, run, split): n}) for (s, _, y, run, split), n in c.items()), Counter())
    assert sizes(got) == sizes(want)


def test_digests_of_batches_are_md5():
    """one block or several, NULL ids, any length and letters."""
    import hashlib
    import numpy as np
    import pyarrow as pa
    from washline.operators.md5 import hex_texts
    from washline.operators.sampling import _digests
    ids = ["x" * k for k in range(70)] + ["e\u0301\u65e5", None, "7-1", "7-1"]
    suffixes = ["0", "split|42", "99"]
    got = {}
    for rows, k, words, top in _digests(pa.array(ids), suffixes):
        for j in range(words.shape[1]):
            for i, h, n in zip(rows.tolist(), hex_texts(np.ascontiguousarray(words[:, j])), top[j].tolist()):
                got[i, k + j] = h
                assert n == int(h[:8], 16)
    assert got == {(i, j): hashlib.md5("|".join(x for x in (t, s) if x is not None).encode()).hexdigest()
                   for i, t in enumerate(ids) for j, s in enumerate(suffixes)}


def test_packed_runs_store_few_md5s(spark):
    """no lambda works out md5s row by row, and only those near a cut are kept."""
    from washline.operators import sampling as P
    pool = spark.createDataFrame([("A", f"s{i}", int(i % 3 == 0)) for i in range(20000)], "state string, segment_id string, y int")
    stats = pool.groupBy("state").agg(F.count_if(F.col("y") == 0).alias("_n"), F.count_if(F.col("y") == 1).alias("_q"))
    seen, old = [], P._settled

    def settled(d, *rest):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        seen.append((d.agg(F.sum(F.size("_marks.near"))).first()[0], "md5(" in plan))
        return old(d, *rest)

    P._settled = settled
    try:
        drawn = F.array_repeat(F.lit(P.FIRST).cast("tinyint"), 3)
        rows = pool.where("y = 0").withColumn("_drawn", drawn)
        firsts = P._marked(rows, ["state"], P._place_bounds(stats, ["state"]), 3, "segment_id", "").collect()
    finally:
        P._settled = old
    assert seen and all(n < 3 * 2000 and not md5 for n, md5 in seen)
    import hashlib
    for run in range(3):
        order = sorted((hashlib.md5(f"{r.segment_id}|{run}".encode()).hexdigest(), r.segment_id) for r in firsts)
        assert {s for _, s in order[:6667]} == {r.segment_id for r in firsts if r._first[run] == P.FIRST}
