"""Water levels over time against road elevations: intervals, as-of join, time under water (preparation, 2.14).

A gauge's readings are joined to intervals by the next reading; the water level runs
straight between them. ``time_under_water`` does not pair roads with intervals: the time a
gauge spends above a level z is a piecewise linear function of z, with a break at every
reading's level. Its breaks and the roads' elevations are sorted together, per gauge,
and running sums of the breaks give each road its answer, with n log n work.

No step needs a whole large gauge in one task: the order of a gauge with many rows is cut into
buckets (``windows.large_bucket``), and what must cross a border (the next reading, the last reading,
sums so far) travels in a table of one row per bucket. Smaller gauges stay whole and need no such row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washline.operators.windows import CUT, _join_keys, large_bucket, next_value, running_totals, small_side

_EXACT = "decimal(32,12)"       # slopes and offsets are rounded once; what is added leaves without a trace when it is subtracted


def reading_intervals(readings: DataFrame, max_gap: float | None = None) -> DataFrame:
    """(gauge, t0, l0, t1, l1, usable) per reading with a later one; ``readings(gauge, t, level)``, t in microseconds.

    Of readings at one time the highest counts; NULLs are left out. An interval longer than ``max_gap`` seconds is not usable.
    """
    rows = large_bucket(readings.select("gauge", "t", "level").dropna(), ["gauge"], "t")
    one = rows.groupBy("gauge", "_bucket", "t").agg(F.max("level").alias("level")).withColumn("_r", F.struct("t", "level"))
    both = next_value(one, ["gauge"], "_r", "_bucket", "_next", CUT).where(F.col("_next").isNotNull())
    gap = (F.col("_next.t") - F.col("t")) / F.lit(1e6)
    return both.select("gauge", F.col("t").alias("t0"), F.col("level").alias("l0"), F.col("_next.t").alias("t1"), F.col("_next.level").alias("l1"),
                       (F.lit(True) if max_gap is None else gap <= F.lit(float(max_gap))).alias("usable"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys at or before ``time`` (NULL: none).

    ``right`` has at most one row per keys and time; neither side has columns that start with ``_a_``.
    """
    payload = F.struct(F.col(time).alias("_a_time"), *values)
    own = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rows = (left.select(*keys, F.col(time).alias("_a_t"), F.lit(1).alias("_a_kind"), own.alias("_a_own"))
            .unionByName(right.select(*keys, F.col(time).alias("_a_t"), F.lit(0).alias("_a_kind"), payload.alias("_a_value")), allowMissingColumns=True))
    rows = large_bucket(rows, keys, "_a_t")
    several = rows.where(CUT).withColumnRenamed("_bucket", "_a_b")
    rows = rows.withColumnRenamed("_bucket", "_a_b")
    ends = several.where("_a_kind = 0").groupBy(*keys, "_a_b").agg(F.max_by("_a_value", "_a_t").alias("_a_last"))
    # every bucket of a cut key needs the last value before it, also where it holds no value itself
    ends = several.select(*keys, "_a_b").distinct().join(ends, [*keys, "_a_b"], "left")
    before = Window.partitionBy(*keys).orderBy("_a_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_a_b", F.last("_a_last", ignorenulls=True).over(before).alias("_a_carry"))
    rows = _join_keys(rows, small_side(carried), [*keys, "_a_b"], "left")
    inside = Window.partitionBy(*keys, "_a_b").orderBy("_a_t", "_a_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last("_a_value", ignorenulls=True).over(inside), F.col("_a_carry"))
    out = rows.withColumn("_a_found", found).where("_a_kind = 1")
    return out.select("_a_own.*", *[F.col(f"_a_found.{v}").alias(v) for v in values])


def level_at(reports: DataFrame, intervals: DataFrame) -> DataFrame:
    """``reports(gauge, t, ...)`` with the interpolated water ``level`` (NULL outside usable intervals)."""
    parts = intervals.where("usable").select("gauge", F.col("t0").alias("t"), "l0", F.col("t1").alias("_t1"), F.col("l1").alias("_l1"), F.col("t0").alias("_t0"))
    met = asof(reports, parts, ["gauge"], "t", ["_t0", "l0", "_t1", "_l1"])
    share = (F.col("t") - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    level = F.when(F.col("t") <= F.col("_t1"), F.col("l0") + (F.col("_l1") - F.col("l0")) * share)
    return met.withColumn("level", level).drop("_t0", "l0", "_t1", "_l1")


def _breaks(intervals: DataFrame) -> DataFrame:
    """(gauge, z, slope, offset, rises): changes, below level z, of time above (offset + slope * level) and of the number of rises."""
    use = intervals.where("usable")
    low, high = F.least("l0", "l1"), F.greatest("l0", "l1")
    seconds = (F.col("t1") - F.col("t0")) / F.lit(1e6)
    use = use.select("gauge", low.alias("low"), high.alias("high"), seconds.alias("dt"), (F.col("l1") > F.col("l0")).cast("long").alias("up"))
    use = use.withColumn("s", F.when(F.col("high") > F.col("low"), F.col("dt") / (F.col("high") - F.col("low"))).otherwise(0.0).cast(_EXACT))
    use = use.withColumn("c", (F.col("high") * F.col("s").cast("double")).cast(_EXACT)).withColumn("dt", F.col("dt").cast(_EXACT))
    zero = F.lit(0).cast(_EXACT)
    flat = F.col("high") == F.col("low")
    top = F.struct(F.col("high").alias("z"), F.when(flat, zero).otherwise(-F.col("s")).alias("slope"),
                   F.when(flat, F.col("dt")).otherwise(F.col("c")).alias("offset"), F.col("up").alias("rises"))
    foot = F.struct(F.col("low").alias("z"), F.when(flat, zero).otherwise(F.col("s")).alias("slope"),
                    F.when(flat, zero).otherwise(F.col("dt") - F.col("c")).alias("offset"), (-F.col("up")).alias("rises"))
    sloped = use.select("gauge", F.explode(F.array(top, foot)).alias("b")).select("gauge", "b.*")
    # a series begins at its first reading, and again after every gap
    first = intervals.groupBy("gauge").agg(F.min(F.struct("t0", "l0")).alias("f")).select("gauge", F.col("f.l0").alias("z"))
    again = intervals.where("not usable").select("gauge", F.col("l1").alias("z"))
    starts = first.unionByName(again).select("gauge", "z", zero.alias("slope"), zero.alias("offset"), F.lit(1).cast("long").alias("rises"))
    return sloped.select("gauge", "z", F.col("slope").cast(_EXACT).alias("slope"), F.col("offset").cast(_EXACT).alias("offset"), "rises").unionByName(starts)


def time_under_water(roads: DataFrame, intervals: DataFrame) -> DataFrame:
    """``roads(road_id, gauge, elevation)`` with ``seconds`` under water, ``floods`` (times the water rises above the road,
    a series that begins above counts) and the gauge's ``peak``; all NULL where the gauge has no interval or a value is missing."""
    peak = small_side(intervals.groupBy("gauge").agg(F.max(F.greatest("l0", "l1")).alias("peak")))
    zero = F.lit(0).cast(_EXACT)
    asked = roads.select("gauge", F.col("elevation").alias("z"), zero.alias("slope"), zero.alias("offset"), F.lit(0).cast("long").alias("rises"),
                         F.lit(0).alias("kind"), "road_id")
    rows = asked.dropna(subset=["gauge", "z"]).unionByName(
        _breaks(intervals).withColumn("kind", F.lit(1)), allowMissingColumns=True).withColumn("down", -F.col("z"))
    rows = large_bucket(rows, ["gauge"], "down")
    # from the highest level down; a road's row comes before the breaks at its own level
    sums = running_totals(rows, ["gauge"], ["down", "kind", "road_id", "rises", "offset"],
                          {"sum_slope": "slope", "sum_offset": "offset", "floods": "rises"}, "_bucket", cut=CUT)
    seconds = F.col("sum_offset").cast("double") + F.col("sum_slope").cast("double") * F.col("z")
    found = sums.where("kind = 0").select("road_id", "gauge", seconds.alias("seconds"), F.col("floods").cast("long").alias("floods"))
    out = roads.select("road_id", "gauge", "elevation").join(found, ["road_id", "gauge"], "left").join(peak, "gauge", "left")
    known = F.col("peak").isNotNull()
    return out.select("road_id", "gauge", "elevation", F.when(known & F.col("seconds").isNotNull(), F.greatest(F.lit(0.0), "seconds")).alias("seconds"),
                      F.when(known, F.col("floods")).alias("floods"), F.when(F.col("seconds").isNotNull(), F.col("peak")).alias("peak"))
