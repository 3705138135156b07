"""Canonical schema, feature sets and the fixed constants of the method.

Everything in the block marked FIXED VALUES must keep these exact values for
results to agree with the published figures; the rest of the engine takes them
as parameters with these defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the method's published settings)
# ---------------------------------------------------------------------------

# Label column and the text label -> class map. Anything else is NULL.
LABEL_COLUMN = "Damage_Status"
LABEL_MAP = {"No Damage": 0, "Damage": 1}

# Canonical predictors of the full model, in training order.
FULL_FEATURES = [
    "aadt_type", "priority", "fedfunccls", "capacity", "jurisdictn", "num_lanes",
    "st_urbrur", "surfc_type", "Shape_Leng", "Z_Min", "Z_Max", "Z_Mean",
    "Min_Slope", "Max_Slope", "Avg_Slope", "Max_Height",
    "Return_Period", "Distance_to_Coast_m", "Max_WVHT", "Max_Dir",
    "Avg_WVHT", "Avg_Dir", "Max_WSPD", "Max_WSPD_Dir", "Avg_WSPD", "Avg_WSPD_Dir",
    "Precipitation", "Rel_Elev_Min", "Rel_Elev_Mean", "Rel_Elev_Max", "Inundation_Duration_Min",
]
# Text-valued predictors of the full model; all others are numeric.
STRING_FEATURES = ["aadt_type", "fedfunccls", "jurisdictn", "st_urbrur", "surfc_type"]

THREE_FEATURES = ["Z_Min", "Distance_to_Coast_m", "Rel_Elev_Min"]
TWO_SLR_FEATURES = ["Distance_to_Coast_m", "Z_Min"]
LINEAR_FEATURES = ["Distance_to_Coast_m", "Inundation_Duration_Min"]

# Fixed screening tree: damage when at least two of the three tests hold.
SCREEN_DISTANCE_MAX = 48.06
SCREEN_REL_ELEV_MAX = 1.71
SCREEN_Z_MIN_MAX = 3.03

# Class threshold on probabilities.
THRESHOLD = 0.5

# Prior shift: training prior, default population prior, per-state overrides.
PI_TRAIN = 0.5
PI_POP_DEFAULT = 1 / 6
PI_POP_BY_STATE = {"TX": 59 / 75}

# Ensemble settings of the published runs.
N_RUNS = 100
FOREST_TREES = 400
FOREST_DEPTH = 3
TREE_DEPTH = 2
TREE_GRID = {
    "class_weight": [None, "balanced"],
    "criterion": ["gini", "entropy"],
    "max_depth": [2, 3, 4, 5, 6, None],
    "min_samples_leaf": [1, 2, 5, 10],
    "min_samples_split": [2, 5, 10],
}
TREE_MIN_LEAF = 10
HOLDOUT_FRACTION = 0.1
TEST_FRACTION = 0.2
HOLDOUT_SEED = 42

# Sea-level-rise scenarios in feet (two study areas) and the unit change.
SCENARIOS_FT_A = [0.0, 1.2, 1.6, 3.9, 6.1, 8.8, 10.9]
SCENARIOS_FT_B = [0.0, 1.0, 2.0, 4.0, 6.0, 8.0]
FEET_TO_M = 0.3048
INUNDATED_SENTINEL = -0.1

# Risk classes. Half-open rule: value == inundated -> Inundated, < 0.33 Low,
# < 0.66 Medium, else High. Closed bins rule: (low, high) inclusive.
RISK_CLASSES = ["Low", "Medium", "High", "Inundated"]
RISK_LOW_MAX = 0.33
RISK_MEDIUM_MAX = 0.66
RISK_INUNDATED_VALUE = -1.0
RISK_BINS = {
    "Low": (0.0, 0.33),
    "Medium": (0.34, 0.66),
    "High": (0.67, 1.0),
    "Inundated": (-0.11, -0.09),
}

# UTM zone 19N on GRS80 (EPSG:26919).
UTM_CENTRAL_MERIDIAN_DEG = -69.0
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
GRS80_A = 6378137.0
GRS80_INV_F = 298.257222101

# Shapley settings: background rows, rows explained, features kept.
SHAP_BACKGROUND_ROWS = 50
SHAP_MAX_ROWS = 550
SHAP_TOP_FEATURES = 10

# ---------------------------------------------------------------------------

FEATURE_SETS = {
    "full31": FULL_FEATURES,
    "three": THREE_FEATURES,
    "two_slr": TWO_SLR_FEATURES,
    "linear2": LINEAR_FEATURES,
}


def canonical_type(name: str) -> T.DataType:
    """Spark type of a canonical column."""
    if name in STRING_FEATURES or name == LABEL_COLUMN:
        return T.StringType()
    return T.DoubleType()


def canonical_schema(features: list[str] | None = None, with_label: bool = True) -> T.StructType:
    cols = list(features or FULL_FEATURES)
    if with_label:
        cols.append(LABEL_COLUMN)
    return T.StructType([T.StructField(c, canonical_type(c), True) for c in cols])


def prior_for_state(state: str, overrides: dict | None = None, default: float = PI_POP_DEFAULT) -> float:
    table = PI_POP_BY_STATE if overrides is None else overrides
    return table.get(state, default)
