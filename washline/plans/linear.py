"""Linear path: OLS on one state, applied to every state (M-4, M-9, M-11, P-6, P-9a, G-*, G-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline import schema as S
from washline.functions import hard_label_ge, label_to_binary, to_number
from washline.operators.metrics import per_group_metrics, roc_curve
from washline.operators.models import LinearModel, fit_ols


def linear_rows(df: DataFrame, features: list[str] = S.LINEAR_FEATURES, keep: list[str] | None = None) -> DataFrame:
    """P-2, P-3, P-6: labelled rows with numeric features; incomplete rows dropped."""
    out = df.select(*(keep or []), label_to_binary(S.LABEL_COLUMN).alias("y"),
                    *[to_number(c).alias(c) for c in features])
    return out.dropna(subset=["y", *features])


def fit_linear(df: DataFrame, features: list[str] = S.LINEAR_FEATURES) -> LinearModel:
    return fit_ols(linear_rows(df, features), features, "y")


def apply_linear(df: DataFrame, model: LinearModel, keep: list[str] | None = None,
                 threshold: float = S.THRESHOLD) -> DataFrame:
    rows = linear_rows(df, model.features, keep)
    return rows.withColumn("score", model.score()).withColumn("y_pred", hard_label_ge("score", threshold))


def linear_metrics(df: DataFrame, model: LinearModel, state_col: str = "state") -> DataFrame:
    scored = apply_linear(df, model, keep=[state_col])
    return per_group_metrics(scored, [state_col], "y", "y_pred", "score")


def linear_roc(df: DataFrame, model: LinearModel, state_col: str = "state") -> DataFrame:
    return roc_curve(apply_linear(df, model, keep=[state_col]), [state_col], "y", "score")


def fit_state(df: DataFrame, state: str, state_col: str = "state",
              features: list[str] = S.LINEAR_FEATURES) -> LinearModel:
    return fit_linear(df.where(F.col(state_col) == state), features)
