"""Ensemble reduction and calibration (A-1 .. A-5, C-1 .. C-5).

Two layouts of the road x model probability matrix are supported:

* wide: one probability column per model on the road's row (the output of a
  compiled tree table); reductions are row-wise Column expressions, no shuffle;
* long: (keys..., run, p); reductions are a grouped aggregation by road.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline import schema as S
from washline.functions import prior_by_state, prior_shift


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def reduce_wide(df: DataFrame, prob_cols: list[str], threshold: float = S.THRESHOLD,
                mean: str = "p_mean_raw", std: str = "p_std", vote: str = "p_vote") -> DataFrame:
    """A-1/A-4 mean, A-2 population std, A-3 vote share (strict >) across model columns."""
    k = float(len(prob_cols))
    m = _sum([F.col(c) for c in prob_cols]) / F.lit(k)
    d = df.withColumn(mean, m)
    var = _sum([(F.col(c) - F.col(mean)) * (F.col(c) - F.col(mean)) for c in prob_cols]) / F.lit(k)
    votes = _sum([(F.col(c) > F.lit(threshold)).cast("double") for c in prob_cols]) / F.lit(k)
    return d.withColumn(std, F.sqrt(var)).withColumn(vote, votes)


def reduce_long(long: DataFrame, keys: list[str], p: str = "p", threshold: float = S.THRESHOLD) -> DataFrame:
    """A-1, A-2, A-3 from the long layout (one row per road and model)."""
    return long.groupBy(*keys).agg(F.avg(p).alias("p_mean_raw"), F.stddev_pop(p).alias("p_std"),
                                   F.avg((F.col(p) > F.lit(threshold)).cast("double")).alias("p_vote"))


def wide_to_long(df: DataFrame, keep: list[str], prob_cols: list[str], runs: list[int]) -> DataFrame:
    """Unpivot the model columns to (keep..., run, p) (a generator, no shuffle)."""
    pairs = F.array(*[F.struct(F.lit(int(r)).alias("run"), F.col(c).alias("p")) for r, c in zip(runs, prob_cols)])
    return df.select(*keep, F.explode(pairs).alias("_rp")).select(*keep, "_rp.run", "_rp.p")


def calibrate_and_shift(df: DataFrame, platt=None, mean: str = "p_mean_raw", state_col: str = "state",
                        priors: dict | None = None, default_prior: float = S.PI_POP_DEFAULT,
                        pi_train: float = S.PI_TRAIN) -> DataFrame:
    """C-1 (Platt apply, when a model is given), then C-5 prior by state and C-4 prior shift."""
    d = df
    calibrated = mean
    if platt is not None:
        d = d.withColumn("p_mean_calib", platt.apply(mean))
        calibrated = "p_mean_calib"
    return d.withColumn("p_mean_adj", prior_shift(F.col(calibrated), prior_by_state(state_col, priors, default_prior), pi_train))
