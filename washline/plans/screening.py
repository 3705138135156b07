"""Screening path: fixed three-threshold tree on every state, metrics per state and pooled.

S-2 -> P-4 -> P-2 -> M-5 -> G-1..G-9, G-16, G-17 (W-5 is the pooled union of the counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washline import schema as S
from washline.functions import label_to_binary, screening_predict
from washline.operators.metrics import binary_report
from washline.operators.prep import require_complete

SCREEN_REQUIRED = ["Distance_to_Coast_m", "Rel_Elev_Min", "Z_Min", S.LABEL_COLUMN]


def screen(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Clean (P-4), label (P-2) and score (M-5) road segments."""
    clean = require_complete(df, SCREEN_REQUIRED)
    return clean.select(*(keep or []), label_to_binary(S.LABEL_COLUMN).alias("y"),
                        screening_predict().alias("y_pred"))


def screening_report(df: DataFrame, state_col: str = "state", pooled_value: str = "ALL") -> DataFrame:
    """Per-state and pooled confusion counts plus the ten metrics.

    The score is the predicted class as a double, so AUC equals balanced accuracy.
    """
    scored = screen(df, keep=[state_col]).withColumn("score", F.col("y_pred").cast("double"))
    return binary_report(scored, state_col, "y", "y_pred", "score", pooled_value)
