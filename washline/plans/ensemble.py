"""Ensemble path: train runs on one state, score every state, reduce, calibrate, evaluate.

D-1 holdout -> D-2/D-3 per run -> M-3 (exact CART, one tree per run, all runs in
one job per level) -> J-5/M-8 (compiled tree table) -> A-1..A-3 -> C-1..C-5 ->
P-9a + G-1..G-9 per (state, run) -> G-11..G-15.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline import schema as S
from washline.functions import label_to_binary
from washline.operators.ensemble import calibrate_and_shift, reduce_wide, wide_to_long
from washline.operators.metrics import per_group_metrics
from washline.operators.models import fit_platt, predict_class
from washline.operators.sampling import holdout_split, packed_runs, unpacked
from washline.operators.trees import count_cells, fit_cart, fit_cart_members, score_own, score_reduced, score_wide, with_tree_cell
from washline.plans.common import materialize


def labeled(seg: DataFrame, features: list[str], strings: tuple | list = ()) -> DataFrame:
    """P-2/P-3 rows with their numeric features and string columns (NULL allowed)."""
    return seg.select("state", "segment_id", label_to_binary(S.LABEL_COLUMN).alias("y"),
                      *[F.col(f).cast("double").alias(f) for f in features], *strings).where(F.col("y").isNotNull())


def training_splits(seg: DataFrame, train_state: str, features: list[str], n_runs: int,
                    strings: tuple | list = ()) -> tuple[DataFrame, DataFrame]:
    """(holdout rows, per-run split rows) of the training state; both stored, the runs packed."""
    holdout, packed = packed_splits(seg, train_state, features, n_runs, strings)
    return holdout, unpacked(packed)


def packed_splits(seg: DataFrame, train_state: str, features: list[str], n_runs: int,
                  strings: tuple | list = ()) -> tuple[DataFrame, DataFrame]:
    """``training_splits`` with the runs as they are stored: one row with all its runs."""
    rows = labeled(seg.where(F.col("state") == train_state), features, strings)
    split = materialize(holdout_split(rows, ["state"]))
    holdout = split.where(F.col("split") == "holdout").drop("split")
    pool = split.where(F.col("split") == "pool").drop("split")
    return holdout, packed_runs(pool, ["state"], n_runs)


def fit_tree_runs(runs: DataFrame, features: list[str] = S.THREE_FEATURES, max_depth: int = S.TREE_DEPTH,
                  min_leaf: int = S.TREE_MIN_LEAF) -> DataFrame:
    """M-3 exact: one CART tree per run on that run's training rows (``runs`` packed or run by run)."""
    if "member" in runs.columns:
        return materialize(fit_cart_members(runs, 1, features, "y", max_depth, min_leaf))
    train = runs.where(F.col("split") == "train")
    return materialize(fit_cart(train, ["run"], features, "y", max_depth, min_leaf))


def score_ensemble(df: DataFrame, trees: DataFrame) -> DataFrame:
    """Mean / std / vote of the runs' probabilities per row."""
    return score_reduced(df, trees, S.THRESHOLD)


def predict_states(seg: DataFrame, trees: DataFrame, features: list[str], priors: dict | None = None, platt=None) -> DataFrame:
    """Per-road predictions of every state: mean, spread, vote, calibrated and shifted mean."""
    wide, runs = score_wide(labeled(seg, features), trees, "run", "p_")       # Column expressions only, as nothing is stored here
    cols = [f"p_{r}" for r in runs]
    return calibrate_and_shift(reduce_wide(wide, cols), platt, priors=priors).drop(*cols)


def evaluate_states(seg: DataFrame, trees: DataFrame, features: list[str], threshold: float = S.THRESHOLD) -> DataFrame:
    """Metrics per (state, run); rows that no tree tells apart are scored once, with their number."""
    cells = count_cells(with_tree_cell(labeled(seg, features), trees)[0], ["state", "y"], features)
    wide, runs = score_wide(cells, trees, "run", "p_")
    long = wide_to_long(wide, ["state", "y", "_rows"], [f"p_{r}" for r in runs], runs)
    long = long.withColumn("y_pred", (F.col("p") >= F.lit(threshold)).cast("int"))
    return per_group_metrics(long, ["state", "run"], "y", "y_pred", "p", "_rows")


def evaluate_own_tests(packed: DataFrame, trees: DataFrame, features: list[str]) -> DataFrame:
    """Metrics per run on its own test split (``member`` 2 of the packed runs), arg-max class."""
    rows, _ = with_tree_cell(packed, trees)
    test = unpacked(rows).where(F.col("split") == "test")
    cells = count_cells(test, ["run", "y"], features)
    long = score_own(cells, trees, ["y", "_rows"], features).withColumn("y_pred", predict_class("p"))
    return per_group_metrics(long, ["run"], "y", "y_pred", "p", "_rows")


def fit_calibration(holdout: DataFrame, trees: DataFrame):
    """A-5 + M-6: ensemble mean on the holdout, then Platt scaling."""
    return fit_platt(score_ensemble(holdout, trees), "p_mean_raw", "y")
