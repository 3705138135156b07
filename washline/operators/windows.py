"""Exact running totals and ranks that do not put a whole group in one task.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts every row of a key in a
single task; when one key holds a third of the data that task is the job. Here
every key is cut into ordered buckets of similar row counts first: bucket totals (a small table, at
most ``n_buckets`` rows per key) give each bucket its offset, and the in-bucket
running sum is a window partitioned by ``(key, bucket)``. The result is exact and
the widest task holds one bucket.

Requirement: the bucket column must be non-decreasing in the sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 64
WHOLE_ROWS = 1 << 16     # a key of up to so many rows is sorted in one task
SMALL_TABLE_LIMIT = 1_000_000


def small_side(df: DataFrame, limit: int = SMALL_TABLE_LIMIT) -> DataFrame:
    """Write a statistics table once and broadcast it when its row count is within ``limit``.

    Joining rows with per-group statistics then never shuffles the rows: the
    statistics (one row per group, or per group and bucket) travel instead.
    """
    from washline.plans.common import materialize
    m = materialize(df)
    return F.broadcast(m) if m.count() <= limit else m


def md5_bucket(md5_col) -> Column:
    """Bucket of a lowercase md5 hex string: its first four hex digits (65,536 buckets)."""
    c = F.col(md5_col) if isinstance(md5_col, str) else md5_col
    return F.conv(F.substring(c, 1, 4), 16, 10).cast("int")


def range_bucket(df: DataFrame, keys: list[str], value: str, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add ``_bucket``: the number of the key's (approximate) percentiles below the value.

    Percentiles follow the rows, so a few far-off values cannot push all others into
    one bucket. Any cut points give exact results downstream, since the bucket never
    decreases with the value and equal values share one.
    """
    return _with_bucket(_join_keys(df, small_side(range_cuts(df, keys, value, n_buckets)), keys), value, F.lit(0))


def range_cuts(df: DataFrame, keys: list[str], value: str, n_buckets: int) -> DataFrame:
    """The keys with the (approximate) percentiles of their values, ``_cuts``."""
    at = [i / n_buckets for i in range(1, n_buckets)]
    return df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, 100 * n_buckets)).alias("_cuts"))


def _with_bucket(df: DataFrame, value: str, default: Column) -> DataFrame:
    below = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(value).cast("double"))))
    return df.withColumn("_bucket", F.coalesce(below, default).cast("int")).drop("_cuts")


def large_bucket(df: DataFrame, keys: list[str], value: str, n_buckets: int = DEFAULT_BUCKETS, whole: int | None = None) -> DataFrame:
    """``range_bucket`` of the keys with more than ``whole`` rows; the others stay whole: their ``_bucket`` is NULL.

    With many small keys neither percentiles nor bucket tables of all of them travel, only those of
    the large keys (at most rows / ``whole``). Give ``CUT`` as ``cut`` to what follows.
    """
    whole = WHOLE_ROWS if whole is None else whole
    large = small_side(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > whole))
    if large.isEmpty():
        return df.withColumn("_bucket", F.lit(None).cast("int"))
    cuts = range_cuts(_join_keys(df, large, keys), keys, value, n_buckets)
    return _with_bucket(_join_keys(df, small_side(cuts), keys, "left"), value, F.lit(None))


CUT = "_bucket is not null"     # rows of the keys that ``large_bucket`` cuts


def running_totals(df: DataFrame, keys: list[str], order: list, sums: dict[str, str],
                   bucket: Column | str, frame: str = "rows", cut: str = "true") -> DataFrame:
    """Add inclusive running sums within ``keys`` following ``order``.

    ``sums`` maps output column -> input column. ``frame='rows'`` counts row by
    row (give a total order for ranks); ``frame='range'`` makes tied rows share
    the sum of all their peers. ``cut`` selects the rows of keys with several buckets.
    """
    bucket_col = F.col(bucket) if isinstance(bucket, str) else bucket
    d = df.withColumn("_rt_b", bucket_col)
    totals = d.where(cut).groupBy(*keys, "_rt_b").agg(*[F.sum(src).alias(f"_rt_t_{out}") for out, src in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_rt_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_rt_b", *[
        F.coalesce(F.sum(f"_rt_t_{out}").over(before), F.lit(0)).alias(f"_rt_o_{out}") for out in sums])
    d = _join_keys(d, small_side(offsets), [*keys, "_rt_b"], "left")
    inner = Window.partitionBy(*keys, "_rt_b").orderBy(*order)
    inner = (inner.rowsBetween(Window.unboundedPreceding, Window.currentRow) if frame == "rows"
             else inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    for out, src in sums.items():
        d = d.withColumn(out, F.coalesce(f"_rt_o_{out}", F.lit(0)) + F.sum(src).over(inner))
    return d.drop("_rt_b", *[f"_rt_o_{out}" for out in sums])


def exact_rank(df: DataFrame, keys: list[str], order: list, bucket: Column | str, out: str = "rank") -> DataFrame:
    """1-based row number within ``keys`` in ``order`` (order must be total)."""
    return running_totals(df.withColumn("_one", F.lit(1)), keys, order, {out: "_one"}, bucket).drop("_one")


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on shared key names, keeping one copy of each key."""
    if not keys:
        return _join_no_keys(left, right)
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_jk_{i}")
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"_jk_{i}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_jk_{i}" for i in range(len(keys))])


def _join_no_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach a one-row statistics frame through a constant key (a broadcast hash join)."""
    return (left.withColumn("_const_k", F.lit(1))
            .join(F.broadcast(right.withColumn("_const_k", F.lit(1))), "_const_k")
            .drop("_const_k"))


def next_value(df: DataFrame, keys: list[str], value: str, bucket: Column | str, out: str = "next_value", cut: str = "true") -> DataFrame:
    """Attach the next larger value within ``keys`` (rows must hold distinct values per key).

    Inside a bucket it is a ``lead``; the last row of a bucket takes the smallest
    value of the next non-empty bucket, read from the small bucket table. ``cut`` selects
    the rows of keys with several buckets.
    """
    bucket_col = F.col(bucket) if isinstance(bucket, str) else bucket
    d = df.withColumn("_nv_b", bucket_col)
    mins = d.where(cut).groupBy(*keys, "_nv_b").agg(F.min(value).alias("_nv_min"))
    nxt = mins.select(*keys, "_nv_b", F.lead("_nv_min").over(Window.partitionBy(*keys).orderBy("_nv_b")).alias("_nv_next"))
    d = _join_keys(d, small_side(nxt), [*keys, "_nv_b"], "left")
    inner = F.lead(value).over(Window.partitionBy(*keys, "_nv_b").orderBy(value))
    return d.withColumn(out, F.coalesce(inner, F.col("_nv_next"))).drop("_nv_b", "_nv_next")
