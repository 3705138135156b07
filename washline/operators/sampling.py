"""Exact-size sampling and splitting keyed by md5 order (D-1 .. D-8, W-4).

Every draw orders rows by ``md5(id || '|' || salt)``, which both Spark and SQL
engines compute identically, so each split has an exact SQL twin. Sizes follow
the stratified-split rule of the method: ``n_test = ceil(frac * n)``; the train
count of each class is the largest-remainder share of ``n - n_test`` and the
rest of the class goes to test.

Selection never sorts a whole group in one task, and never shuffles the rows: the
md5s near the place of the quota-th row give the exact cut, and the cut decides row by row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washline import schema as S
from washline.operators.md5 import hex_texts, run_digests
from washline.operators.windows import _join_keys, exact_rank, md5_bucket, small_side
from washline.session import ship_package


def md5_key(id_col: str, salt) -> Column:
    """md5 hex of ``id|salt``; ``salt`` is a literal value or a Column (e.g. the run)."""
    s = salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), s))


ALL = "g"                     # past every hex digit: each row lies before it


def _cuts(d: DataFrame, keys: list[str], order_col: str, quota: str) -> DataFrame:
    """Exactly one row per group: the md5 ``_cut`` of the quota-th row, how many of the rows with just that md5 belong
    to the first ``quota`` (``_take``), and whether that leaves some of them out (``_partial``).

    Built from counts per first two hex digits (combined map-side); only the digits that hold the quota-th row are
    counted md5 by md5. A quota of zero or less (or NULL) cuts before the first row, one of at least the group's size
    after the last.
    """
    totals = d.groupBy(*keys, F.substring(order_col, 1, 2).alias("_fb")).agg(F.count(F.lit(1)).alias("_ft"), F.first(quota).alias("_q"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = part.orderBy("_fb").rowsBetween(Window.unboundedPreceding, -1)
    cum = totals.withColumn("_fo", F.coalesce(F.sum("_ft").over(before), F.lit(0)))
    hit = (F.col("_fo") < F.col("_q")) & (F.col("_fo") + F.col("_ft") >= F.col("_q"))
    grouped = cum.groupBy(*keys).agg(F.sum("_ft").alias("_n"), F.coalesce(F.first("_q"), F.lit(0)).alias("_q"),
                                     F.max(F.when(hit, F.col("_fb"))).alias("_b"), F.max(F.when(hit, F.col("_fo"))).alias("_o"))
    grouped = small_side(grouped.select(*keys, "_q", "_o", F.when((F.col("_q") > 0) & (F.col("_q") < F.col("_n")), F.col("_b")).alias("_b"),
                                        F.when(F.col("_q") <= 0, F.lit("")).otherwise(F.lit(ALL)).alias("_end")))
    edge = _join_keys(d.select(*keys, F.col(order_col).alias("_m")), grouped.where("_b is not null").select(*keys, "_q", "_o", "_b"), keys)
    edge = edge.where(F.substring("_m", 1, 2) == F.col("_b")).groupBy(*keys, "_m").agg(F.count(F.lit(1)).alias("_c"), F.first("_q").alias("_q"), F.first("_o").alias("_o"))
    found = _cut_rows(edge, keys)
    whole = grouped.where("_b is null").select(*keys, F.col("_end").alias("_cut"), F.lit(0).cast("long").alias("_take"), F.lit(False).alias("_partial"))
    return whole.unionByName(found)


def _cut_rows(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _cut, _take, _partial) of ``counts(keys, _m, _c, _o, _q)``: the md5 at which ``_o`` and the counts so far reach the quota."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.coalesce(F.sum("_c").over(part.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("_before", F.col("_o") + upto)
    c = c.where((F.col("_before") < F.col("_q")) & (F.col("_before") + F.col("_c") >= F.col("_q")))
    return c.select(*keys, F.col("_m").alias("_cut"), (F.col("_q") - F.col("_before")).cast("long").alias("_take"),
                    (F.col("_before") + F.col("_c") > F.col("_q")).alias("_partial"))


def _bounds(df: DataFrame, keys: list[str], quota: str) -> DataFrame:
    """One row per group: ``_q``, whether a cut ``_inside`` it is needed, and two hex strings around the place of that cut.

    md5s are spread evenly, so the quota-th of n lies near quota / n. Wide as the bounds are, the caller checks that they hold.
    """
    return _place_bounds(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.first(quota), F.lit(0)).cast("long").alias("_q")), keys)


def _place_bounds(stats: DataFrame, keys: list[str]) -> DataFrame:
    """``_bounds`` of groups of ``_n`` rows with quota ``_q``."""
    share = F.col("_q") / F.greatest(F.col("_n"), F.lit(1))
    inside = (F.col("_q") > 0) & (F.col("_q") < F.col("_n"))
    slack = F.when(inside, 6 * F.sqrt(share * (1 - share) / F.col("_n")) + 16 / F.col("_n")).otherwise(F.lit(0.0))

    def text(at: Column) -> Column:
        digits = F.lower(F.lpad(F.hex(F.floor(at * F.lit(float(1 << 32))).cast("long")), 8, "0"))
        return F.when(at <= 0, F.lit("")).when(at >= 1, F.lit(ALL)).otherwise(digits)
    return stats.select(*keys, "_q", inside.alias("_inside"), text(share - slack).alias("_lo"), text(share + slack).alias("_hi"))


def _chosen(df: DataFrame, keys: list[str], order_col: str, quota: str, out: str, keep_all: bool) -> DataFrame:
    """The rows of ``df`` without ``order_col``, flagged ``out`` if they are among the first ``quota`` of their group
    (or only those); NULL keys are a group like any other.

    The md5s are computed once: rows are written with what the bounds say of them, and only those between the bounds keep
    their md5, of which the exact cut follows. If a cut lies outside its bounds, counts of all md5s give it instead.
    """
    from washline.plans.common import materialize

    mk = F.col(order_col)
    bounds = small_side(_bounds(df, keys, quota))
    d = _join_keys(df, bounds.select(*keys, "_lo", "_hi"), keys)
    d = d if keep_all else d.where(mk < F.col("_hi"))
    sure = mk < F.col("_lo")
    d = materialize(d.withColumn("_in", sure).withColumn("_m", F.when(~sure & (mk < F.col("_hi")), mk)).drop(order_col, "_lo", "_hi"))
    known = _join_keys(d.groupBy(*keys).agg(F.count_if("_in").alias("_o")), bounds.where("_inside").select(*keys, "_q"), keys)
    near = d.where("_m is not null").groupBy(*keys, "_m").agg(F.count(F.lit(1)).alias("_c"))
    found = _cut_rows(_join_keys(near, small_side(known), keys), keys)
    none = bounds.select(*keys, "_inside", F.lit(None).cast("string").alias("_cut"), F.lit(0).cast("long").alias("_take"), F.lit(False).alias("_partial"))
    cuts = none.unionByName(found.withColumn("_inside", F.lit(True))).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_inside", "_cut", "_take", "_partial")])
    cuts = small_side(cuts)
    lost = cuts.where("_inside and _cut is null").limit(1).collect()
    if lost:
        cuts = small_side(_cuts(df, keys, order_col, quota))
        d = df.withColumn("_in", F.lit(False)).withColumnRenamed(order_col, "_m")
    d = _join_keys(d, cuts.select(*keys, "_cut", "_take", "_partial"), keys)
    picked = F.col("_in") | F.coalesce(F.col("_m") <= F.col("_cut"), F.lit(False))
    extra = ["_in", "_m", "_cut", "_take", "_partial"]
    if cuts.where("_partial").limit(1).collect():
        # equal md5s straddle a cut: those rows are counted off
        split = F.coalesce(F.col("_m") == F.col("_cut"), F.lit(False)) & F.col("_partial")
        ties = Window.partitionBy(*keys, "_m").orderBy("_m")
        counted = d.where(split).withColumn(out, F.row_number().over(ties) <= F.col("_take"))
        d = d.where(~split).withColumn(out, picked).unionByName(counted)
    else:
        d = d.withColumn(out, picked)
    d = d.drop(*extra)
    return d if keep_all else d.where(out).drop(out)


def first_n_flag(df: DataFrame, keys: list[str], order_col: str, quota: str, out: str = "selected") -> DataFrame:
    """Flag the first ``quota`` rows of every ``keys`` group in md5 ``order_col`` order; ``order_col`` itself is left out.

    ``quota`` is a column already on ``df`` (constant within a group). No task ever sorts a whole group.
    """
    return _chosen(df, keys, order_col, quota, out, True)


def first_n(df: DataFrame, keys: list[str], order_col: str, quota: str) -> DataFrame:
    """Only the first ``quota`` rows per group (md5 order); the others are dropped map-side. ``order_col`` is left out."""
    return _chosen(df, keys, order_col, quota, "_chosen", False)


def class_quotas(df: DataFrame, keys: list[str], label: str, frac: float) -> DataFrame:
    """Per (keys, class): n_class, train and test counts of an exact stratified split."""
    return _class_shares(df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_class")), keys, label, frac)


def _class_shares(counts: DataFrame, keys: list[str], label: str, frac: float) -> DataFrame:
    """``class_quotas`` of ``counts(keys, label, n_class)``."""
    g = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.sum("n_class").over(g)
    c = counts.withColumn("_n", n).withColumn("_n_test", F.ceil(F.lit(float(frac)) * F.col("_n")).cast("bigint"))
    c = c.withColumn("_n_train", F.col("_n") - F.col("_n_test"))
    c = c.withColumn("_cont", F.col("n_class") / F.col("_n") * F.col("_n_train"))
    c = c.withColumn("_floor", F.floor("_cont").cast("bigint")).withColumn("_rem", F.col("_cont") - F.col("_floor"))
    c = c.withColumn("_need", F.col("_n_train") - F.sum("_floor").over(g))
    order = Window.partitionBy(*keys).orderBy(F.desc("_rem"), F.desc("n_class"), F.asc(label)) if keys else \
        Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), F.desc("n_class"), F.asc(label))
    c = c.withColumn("n_train", F.col("_floor") + F.when(F.row_number().over(order) <= F.col("_need"), 1).otherwise(0))
    return c.select(*keys, label, "n_class", F.col("n_train").cast("bigint").alias("n_train"),
                    (F.col("n_class") - F.col("n_train")).cast("bigint").alias("n_test"))


def stratified_split(df: DataFrame, keys: list[str], label: str, id_col: str, frac: float, salt,
                     test_value: str = "test", train_value: str = "train", out: str = "split") -> DataFrame:
    """D-1 / D-3 / D-4: exact stratified split; the first n_test rows of each class (md5 order) are test."""
    quotas = small_side(class_quotas(df, keys, label, frac).select(*keys, label, "n_test"))
    d = _join_keys(df, quotas, [*keys, label]).withColumn("_mk", md5_key(id_col, salt))
    flagged = first_n_flag(d, [*keys, label], "_mk", "n_test", "_is_test")
    return flagged.withColumn(out, F.when(F.col("_is_test"), F.lit(test_value)).otherwise(F.lit(train_value))).drop(
        "_is_test", "_mk", "n_test")


def exact_split(df: DataFrame, keys: list[str], id_col: str, frac: float, salt,
                test_value: str = "test", train_value: str = "train", out: str = "split") -> DataFrame:
    """D-4: exact-size split without stratification: the first ceil(frac * n) rows of each group
    (md5 order) are test, whatever their class."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    quota = small_side(counts.select(*keys, F.ceil(F.lit(float(frac)) * F.col("_n")).cast("bigint").alias("_n_test")))
    d = _join_keys(df, quota, keys).withColumn("_mk", md5_key(id_col, salt))
    flagged = first_n_flag(d, keys, "_mk", "_n_test", "_is_test")
    return flagged.withColumn(out, F.when(F.col("_is_test"), F.lit(test_value)).otherwise(F.lit(train_value))).drop(
        "_is_test", "_mk", "_n_test")


def holdout_split(df: DataFrame, keys: list[str], label: str = "y", id_col: str = "segment_id",
                  frac: float = S.HOLDOUT_FRACTION, seed: int = S.HOLDOUT_SEED) -> DataFrame:
    """D-1: calibration holdout (``split`` = holdout | pool)."""
    return stratified_split(df, keys, label, id_col, frac, seed, "holdout", "pool")


def fan_out_runs(df: DataFrame, n_runs: int, run_col: str = "run") -> DataFrame:
    """D-6: one copy of every row per run (a generator, not a join)."""
    return df.withColumn(run_col, F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))


def balanced_runs(pool: DataFrame, keys: list[str], n_runs: int, label: str = "y",
                  id_col: str = "segment_id") -> DataFrame:
    """D-2 + D-6 + W-4: per run, all positives plus as many negatives drawn without replacement.

    Negatives are ordered by md5(id|run); the quota is the positive count of the
    group. The bucket filter drops unselected negatives before any shuffle of rows.
    """
    n_pos = pool.where(F.col(label) == 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_pos"))
    pos = fan_out_runs(pool.where(F.col(label) == 1), n_runs)
    neg = _join_keys(fan_out_runs(pool.where(F.col(label) == 0), n_runs), small_side(n_pos), keys)
    neg = neg.withColumn("_mk", md5_key(id_col, F.col("run")))
    picked = first_n(neg, [*keys, "run"], "_mk", "_n_pos").drop("_mk", "_n_pos")
    return pos.unionByName(picked)


def run_splits(balanced: DataFrame, keys: list[str], frac: float = S.TEST_FRACTION, label: str = "y",
               id_col: str = "segment_id") -> DataFrame:
    """D-3: stratified train/test split inside every (keys, run), salted by the run."""
    salted = balanced.withColumn("_salt", F.concat(F.lit("split|"), F.col("run").cast("string")))
    return stratified_split(salted, [*keys, "run"], label, id_col, frac, F.col("_salt")).drop("_salt")


def _settled(d: DataFrame, keys: list[str], bounds: DataFrame, n_runs: int) -> tuple[DataFrame, list[int]]:
    """The exact cuts of all runs as an array per group, ``_cuts`` of (_cut, _take, _partial), from what ``_marks`` says of
    the rows; and the runs of which some cut was not found."""
    sure = d.select(*keys, F.posexplode("_marks.c").alias("run", "_at")).where(F.col("_at") == BEFORE)
    sure = sure.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("_o"))
    near = d.select(*keys, F.explode("_marks.near").alias("_e")).groupBy(*keys, F.col("_e.run").alias("run"), F.col("_e.m").alias("_m")).agg(
        F.count(F.lit(1)).alias("_c"))
    runs = F.sequence(F.lit(0), F.lit(n_runs - 1))
    wanted = bounds.where("_inside").select(*keys, "_q", F.explode(runs).alias("run"))
    known = _join_keys(wanted, sure, [*keys, "run"], "left").withColumn("_o", F.coalesce("_o", F.lit(0)))
    found = small_side(_cut_rows(_join_keys(near, small_side(known), [*keys, "run"]), [*keys, "run"]))
    by_run = F.map_from_entries(F.collect_list(F.struct("run", F.struct("_cut", "_take", "_partial"))))
    cuts = found.groupBy(*keys).agg(by_run.alias("_of")).select(*keys, F.transform(runs, lambda r: F.col("_of")[r]).alias("_cuts"))
    lost = _join_keys(wanted, found.withColumn("_found", F.lit(1)), [*keys, "run"], "left").where("_found is null").select("run").distinct()
    return small_side(_join_keys(bounds.select(*keys), cuts, keys, "left")), [r.run for r in lost.collect()]


NOT_IN, BEFORE, NEAR, BEHIND = 0, 1, 2, 3       # a row's place in a run: not in it, before, between, behind the bounds
_MARKS = "struct<c: array<tinyint>, near: array<struct<run: int, m: string>>>"


def _marks_array(codes: np.ndarray, row: np.ndarray, run: np.ndarray, text: np.ndarray) -> pa.Array:
    """``_MARKS`` of (rows, runs) codes and the near md5s ``text`` by row and run."""
    order = np.lexsort((run, row))
    near = pa.StructArray.from_arrays([pa.array(run[order], pa.int32()), pa.array(text[order].tolist(), pa.string())], names=["run", "m"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(codes)))])
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int8())),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)]
    return pa.StructArray.from_arrays(lists, names=["c", "near"])


def _codes(lists: pa.Array, n_runs: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(len(lists), n_runs)


def _digests(ids: pa.Array, suffixes: list[str]):
    """Pieces of ``md5_key`` of all ids: (rows, first suffix, digest words, first eight hex digits as numbers); NULL ids are left out of the text."""
    texts = ids.to_pylist()
    have = np.array([i for i, t in enumerate(texts) if t is not None], np.int64)
    for rows, k, words in run_digests([texts[i].encode() for i in have.tolist()], [x.encode() for x in suffixes]):
        yield have[rows], k, words, words[0].byteswap().astype(np.int64)
    none = np.array([i for i, t in enumerate(texts) if t is None], np.int64)
    for k, x in enumerate(suffixes if len(none) else []):
        words = np.frombuffer(hashlib.md5(x.encode()).digest(), "<u4").astype(np.uint32)[:, None, None].repeat(len(none), 2)
        yield none, k, words, words[0].byteswap().astype(np.int64)


def _bound(texts: pa.Array) -> np.ndarray:
    """Bounds as numbers: no md5 lies before '', each before ``ALL``."""
    d = texts.dictionary_encode()
    known = np.array([0 if t == "" else 1 << 32 if t == ALL else int(t, 16) for t in d.dictionary.to_pylist()], np.int64)
    return known[d.indices.to_numpy(zero_copy_only=False)]


def _marker(salt: str, n_runs: int):
    """Every run's place of a row between the bounds, by md5 of ``id|<salt><run>``."""
    suffixes = [f"{salt}{r}" for r in range(n_runs)]

    def marks(ids: pa.Array, lo: pa.Array, hi: pa.Array, drawn: pa.Array) -> pa.Array:
        low, high, member = _bound(lo), _bound(hi), _codes(drawn, n_runs) == FIRST
        codes, parts = np.zeros((len(ids), n_runs), np.int8), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))]
        for rows, k, words, top in _digests(ids, suffixes):
            code = (top >= low[rows]).view(np.int8) + (top >= high[rows]).view(np.int8) + np.int8(BEFORE)
            code *= member[rows, k:k + len(code)].T.view(np.int8)
            codes[rows, k:k + len(code)] = code.T
            run, at = np.nonzero(code == NEAR)
            parts.append((rows[at], run + k, np.array(hex_texts(words[:, run, at]), object)))
        return _marks_array(codes, *(np.concatenate(x) for x in zip(*parts)))

    return F.arrow_udf(marks, _MARKS)


def _lost_marker(salt: str, n_runs: int, lost: list[int]):
    """``_marker``'s marks with the md5s of all rows that are in the ``lost`` runs, where a cut is needed."""
    suffixes = [f"{salt}{r}" for r in lost]

    def marks(ids: pa.Array, inside: pa.Array, before: pa.Array) -> pa.Array:
        codes = _codes(before.field("c"), n_runs).copy()
        near = before.field("near")
        row = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy(zero_copy_only=False))
        run = near.flatten().field("run").to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.array(near.flatten().field("m").to_pylist(), object)
        need = inside.to_numpy(zero_copy_only=False).astype(bool)[:, None] & (codes[:, lost] != NOT_IN)
        keep = ~(np.isin(run, lost) & need[row].any(1)) if len(run) else np.zeros(0, bool)
        parts = [(row[keep], run[keep], text[keep])]
        for rows, k, words, _ in _digests(ids, suffixes):
            j, at = np.nonzero(need[rows, k:k + words.shape[1]].T)
            parts.append((rows[at], np.array(lost, np.int64)[j + k], np.array(hex_texts(words[:, j, at]), object)))
        codes[:, lost] = np.where(need, NEAR, codes[:, lost])
        return _marks_array(codes, *(np.concatenate(x) for x in zip(*parts)))

    return F.arrow_udf(marks, _MARKS)


NOT_FIRST, FIRST = 1, 2


def _firsts(n_runs: int):
    """Per run: ``NOT_IN``, ``NOT_FIRST`` or ``FIRST``, of the marks and the verdicts on the near md5s."""
    def firsts(marks: pa.Array, verdict: pa.Array) -> pa.Array:
        codes = _codes(marks.field("c"), n_runs)
        out = np.array([NOT_IN, FIRST, NOT_FIRST, NOT_FIRST], np.int8)[codes]
        near = marks.field("near")
        row = np.repeat(np.arange(len(codes)), near.value_lengths().to_numpy(zero_copy_only=False))
        run = near.flatten().field("run").to_numpy(zero_copy_only=False)
        yes = verdict.flatten().to_numpy(zero_copy_only=False).astype(bool)
        out[row[yes], run[yes]] = FIRST
        return pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * n_runs, pa.int32()), pa.array(out.ravel(), pa.int8()))

    return F.arrow_udf(firsts, "array<tinyint>").asNondeterministic()     # not worked out once more for a filter


def _marked(d: DataFrame, keys: list[str], bounds: DataFrame, n_runs: int, id_col: str, salt: str) -> DataFrame:
    """``d`` with ``_first``, an array over the runs: whether the row is among the first ``_q`` of its group by that run's
    md5 of ``id|<salt><run>`` (``NOT_IN`` where ``_drawn`` is not ``FIRST``: the row is not in that run). ``_drawn`` goes.

    md5s are worked out for whole batches; only those between the bounds are stored.
    """
    from washline.plans.common import materialize

    ship_package(d.sparkSession)
    text = F.col(id_col).cast("string")
    rows = _join_keys(d, bounds.select(*keys, "_inside", "_lo", "_hi"), keys)
    rows = materialize(rows.withColumn("_marks", _marker(salt, n_runs)(text, "_lo", "_hi", "_drawn")).drop("_lo", "_hi", "_drawn")
                       .withColumn("_row", F.monotonically_increasing_id()))
    cuts, lost = _settled(rows, keys, bounds, n_runs)
    if lost:        # such a run's cut lies outside the bounds (its md5s also chose the pool): all its md5s are looked at
        rows = materialize(rows.withColumn("_marks", _lost_marker(salt, n_runs, lost)(text, "_inside", "_marks")))
        cuts, lost = _settled(rows, keys, bounds, n_runs)
    rows = _join_keys(rows, cuts, keys)
    before = lambda e: F.coalesce(e["m"] <= F.get("_cuts", e["run"])["_cut"], F.lit(False))
    verdict = F.transform("_marks.near", before)
    if cuts.where(F.exists("_cuts", lambda c: F.coalesce(c["_partial"], F.lit(False)))).limit(1).collect():
        # equal md5s straddle a cut: those rows are counted off
        cut = F.get("_cuts", F.col("run"))
        tied = rows.select(*keys, "_row", "_cuts", F.explode("_marks.near").alias("_e")).select(*keys, "_row", "_cuts", "_e.run", F.col("_e.m").alias("_m"))
        tied = tied.where((F.col("_m") == cut["_cut"]) & cut["_partial"])
        order = Window.partitionBy(*keys, "run").orderBy("_row")
        over = tied.withColumn("_k", F.row_number().over(order)).where(F.col("_k") > cut["_take"])
        over = over.groupBy("_row").agg(F.collect_set("run").alias("_over"))
        rows = rows.join(small_side(over), "_row", "left")
        out = F.coalesce(F.col("_over"), F.array().cast("array<int>"))
        verdict = F.transform("_marks.near", lambda e: before(e) & ~F.array_contains(out, e["run"]))
    return rows.withColumn("_first", _firsts(n_runs)("_marks", verdict)).drop("_marks", "_row", "_cuts", "_over", "_inside")


def packed_runs(pool: DataFrame, keys: list[str], n_runs: int, frac: float = S.TEST_FRACTION, label: str = "y",
                id_col: str = "segment_id") -> DataFrame:
    """D-2, D-3, D-6 of all runs with one row per pool row: ``member``, an array over the runs (0 not drawn, 1 train, 2 test).

    The same draws and splits as ``run_splits(balanced_runs(...))``; rows are not copied per run, and
    rows that no run draws are left out. ``unpacked`` lists them run by run.
    """
    from washline.plans.common import materialize

    # as many md5s a row as runs: a small file must not be the work of one task
    pool = pool.where(F.col(label).isin(0, 1)).repartition(2 * pool.sparkSession.sparkContext.defaultParallelism)
    counts = small_side(pool.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("_n_pos"), F.count_if(F.col(label) == 0).alias("_n")))
    stats = counts.select(*keys, "_n", F.col("_n_pos").alias("_q"))
    all_runs = F.array_repeat(F.lit(FIRST).cast("tinyint"), n_runs)
    negatives = _marked(pool.where(F.col(label) == 0).withColumn("_drawn", all_runs), keys, small_side(_place_bounds(stats, keys)), n_runs, id_col, "")
    negatives = negatives.where(F.array_contains("_first", F.lit(FIRST).cast("tinyint")))
    both = pool.where(F.col(label) == 1).withColumn("_drawn", all_runs).unionByName(negatives.withColumnRenamed("_first", "_drawn"))
    # every run draws equally many rows of a class, so the quotas are those of one run
    each = counts.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("l"), F.least("_n", "_n_pos").alias("n")), F.struct(F.lit(1).alias("l"), F.col("_n_pos").alias("n")))).alias("_e"))
    kind = dict(pool.dtypes)[label]
    each = each.select(*keys, F.col("_e.l").cast(kind).alias(label), F.col("_e.n").alias("n_class")).where("n_class > 0")
    quotas = materialize(_class_shares(each, keys, label, frac).select(*keys, label, F.col("n_class").alias("_n"), F.col("n_test").alias("_q")))

    out = _marked(both, [*keys, label], small_side(_place_bounds(quotas, [*keys, label])), n_runs, id_col, "split|")
    return materialize(out.withColumnRenamed("_first", "member"))       # the first are the test rows


def unpacked(packed: DataFrame) -> DataFrame:
    """The rows of ``packed_runs`` run by run, with ``run`` and ``split`` (train, test)."""
    rest = [c for c in packed.columns if c != "member"]
    d = packed.select(*rest, F.posexplode("member").alias("run", "_k")).where("_k > 0")
    return d.withColumn("split", F.when(F.col("_k") == 2, F.lit("test")).otherwise(F.lit("train"))).drop("_k")


def bounded_sample(df: DataFrame, keys: list[str], k: int, id_col: str = "segment_id", seed=0) -> DataFrame:
    """D-5 / X-1: at most k rows per group, the first k in md5(id|seed) order."""
    d = df.withColumn("_mk", md5_key(id_col, seed)).withColumn("_k", F.lit(int(k)))
    return first_n(d, keys, "_mk", "_k").drop("_mk", "_k")


def stratified_folds(df: DataFrame, keys: list[str], k: int = 5, label: str = "y",
                     id_col: str = "segment_id", seed=S.HOLDOUT_SEED, out: str = "fold") -> DataFrame:
    """D-7: fold = (rank - 1) mod k within each (keys, class) in md5 order."""
    d = df.withColumn("_mk", md5_key(id_col, seed))
    ranked = exact_rank(d, [*keys, label], ["_mk"], md5_bucket("_mk"), "_rk")
    return ranked.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_rk", "_mk")
