"""Scalar Column functions (section F of the inventory and the per-value helpers)."""

from washline.functions.columns import (  # noqa: F401
    expit,
    feet_to_m,
    hard_label_ge,
    hard_label_gt,
    in_bin,
    label_to_binary,
    logit,
    logit_value,
    mean_std_text,
    nan_to_null,
    platt_apply,
    point_segment_distance,
    prior_by_state,
    prior_shift,
    risk_class,
    screening_predict,
    to_number,
    utm_project,
)
