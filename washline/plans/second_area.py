"""The second study area: two features, distances to the coast polygon, 0 inside, shifted ground elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline import schema as S
from washline.plans import catalog as K
from washline.plans.common import materialize, round_doubles
from washline.plans.sqltext import cart_ctes, crossing_sql, seg_dist_sql, tree_score_ctes, with_segments
from washline.sources.fixtures import inundation_edges, inundation_edges_sql

FEATURES, SCENARIOS = S.TWO_SLR_FEATURES, S.SCENARIOS_FT_B

_SPLITS = K._ens_split_ctes()
_SPLITS = _SPLITS[:[n for n, _ in _SPLITS].index("etrain") + 1]
_VALUES = ", ".join(f"(CAST({s!r} AS DOUBLE))" for s in SCENARIOS)
_CTES = [
    *_SPLITS, *cart_ctes("etrain", FEATURES, S.TREE_DEPTH, S.TREE_MIN_LEAF),
    ("pts", "SELECT segment_id, x, y, Z_Min FROM segments"),
    ("edges", inundation_edges_sql(SCENARIOS)),
    ("xing", f"""SELECT e.scenario_ft, p.segment_id, e.poly_id, count(*) FILTER (WHERE {crossing_sql('p.x', 'p.y')}) AS cnt,
                min({seg_dist_sql('p.x', 'p.y')}) AS d FROM pts p CROSS JOIN edges e GROUP BY e.scenario_ft, p.segment_id, e.poly_id"""),
    ("near", "SELECT scenario_ft, segment_id, bool_or(cnt % 2 = 1) AS inside, min(d) AS d FROM xing GROUP BY scenario_ft, segment_id"),
    ("fan", f"""SELECT s.scenario_ft, p.segment_id, s.scenario_ft > 0 AND n.inside AS Inundated, CASE WHEN n.inside THEN 0.0 ELSE n.d END AS dist_out,
                p.Z_Min AS z_before, p.Z_Min - s.scenario_ft * CAST({S.FEET_TO_M} AS DOUBLE) AS z_out
                FROM pts p CROSS JOIN (VALUES {_VALUES}) s(scenario_ft) JOIN near n ON n.scenario_ft = s.scenario_ft AND n.segment_id = p.segment_id"""),
    ("model_in", "SELECT *, dist_out AS Distance_to_Coast_m, z_out AS Z_Min FROM fan"),
    *tree_score_ctes("model_in", "trees", FEATURES, ["scenario_ft", "segment_id", "Inundated", "dist_out", "z_before", "z_out"], S.TREE_DEPTH),
    ("slr", f"""SELECT scenario_ft, segment_id, Inundated, dist_out, z_before, z_out,
                CASE WHEN Inundated THEN {S.INUNDATED_SENTINEL} ELSE avg(p) END AS Washout_Probability
                FROM scored_long GROUP BY scenario_ft, segment_id, Inundated, dist_out, z_before, z_out"""),
]
_PRED_SQL = with_segments(*_CTES) + """
SELECT scenario_ft, segment_id, Inundated, ROUND(dist_out, 6) AS Distance_to_Coast_m, ROUND(z_before, 6) AS Z_Min_original,
  ROUND(z_out, 6) AS Z_Min, ROUND(Washout_Probability, 6) AS Washout_Probability FROM slr
"""
_BINNED = ", ".join(f"""ROUND(CAST(count(*) FILTER (WHERE Washout_Probability >= {lo} AND Washout_Probability <= {hi}) AS DOUBLE)
  / CAST(count(*) AS DOUBLE) * 100.0, 6) AS {c}""" for c, (lo, hi) in S.RISK_BINS.items())
_BIN_SQL = with_segments(*_CTES) + f"""
SELECT scenario_ft AS Scenario_ft, {_BINNED}, ROUND(scenario_ft * CAST({S.FEET_TO_M} AS DOUBLE), 6) AS Scenario_m FROM slr GROUP BY scenario_ft
"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.scenario import mark_inundated
    from washline.operators.trees import score_reduced
    from washline.plans.ensemble import fit_tree_runs
    from washline.plans.slr import scenario_features
    key = ("second area", K._sid(spark), sf_dir)
    if key not in K._CACHE:
        trees = fit_tree_runs(K._ensemble_splits(spark, sf_dir)[1], FEATURES)
        points = K.segments(spark, sf_dir).select("segment_id", "x", "y", "Z_Min", F.lit(None).cast("double").alias("Distance_to_Coast_m"))
        edges = materialize(inundation_edges(spark, sf_dir, SCENARIOS))
        feats = materialize(scenario_features(points, edges, SCENARIOS, shifted="Z_Min", inundated_distance="zero", base="coast"))
        red = score_reduced(feats, trees, S.THRESHOLD, mean="_avg", std="_std", vote="_vote")
        K._CACHE[key] = materialize(red.select("scenario_ft", "segment_id", "Inundated", "Distance_to_Coast_m", "Z_Min_original", "Z_Min",
                                               mark_inundated("_avg", "Inundated").alias("Washout_Probability")))
    return K._CACHE[key]


@K.register("b_slr_scenario_predictions", _PRED_SQL)
def b_slr_scenario_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_predictions(spark, sf_dir))


@K.register("b_r2_binned_summary", _BIN_SQL)
def b_r2_binned_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.scenario import risk_bin_summary
    return round_doubles(risk_bin_summary(_predictions(spark, sf_dir).withColumnRenamed("scenario_ft", "Scenario_ft")))
