"""Query catalog: one Spark query and (where expressible) one DuckDB oracle per operator group.

Every query reads the driver tables through the ``segments`` view (or data Spark
derives from it), so its work grows with the input. Names carry the inventory ids
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.plans.common import materialize, round_doubles, write_table
from washline.plans.screening import screening_report
from washline.plans.sqltext import (
    auc_sql,
    cart_ctes,
    counts_sql,
    crossing_sql,
    div,
    expit_sql,
    label_sql,
    logit_sql,
    md5_sql,
    metrics_select,
    platt_ctes,
    quota_sql,
    screening_sql,
    seg_dist_sql,
    tree_score_ctes,
    with_segments,
)
from washline import schema as S
from washline.sources.fixtures import inundation_edges_sql
from washline.sources.fixtures import segments as _segments_view

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}
_CACHE: dict = {}


def _sid(spark: SparkSession) -> str:
    """Cache key of a live session (application id; object id as a fallback)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # pragma: no cover
        return str(id(spark))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment view, written once per session to the checkpoint folder.

    It stands in for a stored road table: later queries scan it instead of
    re-running the five-way join of the driver tables.
    """
    key = ("segments", _sid(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = write_table(_segments_view(spark, sf_dir), "segments")
    return _CACHE[key]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ---------------------------------------------------------------------------
# M-5 screening tree, per state and pooled: S-2, P-4, P-2, M-5, G-1..G-9, G-16, G-17, W-5
# ---------------------------------------------------------------------------

_SCREEN_SQL = with_segments(
    ("scored", f"""SELECT state, {label_sql()} AS y, {screening_sql()} AS y_pred,
                  CAST({screening_sql()} AS DOUBLE) AS score
                  FROM segments WHERE Distance_to_Coast_m IS NOT NULL AND Rel_Elev_Min IS NOT NULL
                  AND Z_Min IS NOT NULL AND Damage_Status IN ('Damage', 'No Damage')"""),
    ("pooled", "SELECT state, y, y_pred, score FROM scored UNION ALL SELECT 'ALL' AS state, y, y_pred, score FROM scored"),
    ("counts", counts_sql("pooled", ["state"])),
    ("aucs", auc_sql("pooled", ["state"])),
) + f"""
SELECT c.state, tn, fp, fn, tp, {', '.join(metrics_select())}, ROUND(a.auc, 6) AS auc
FROM counts c LEFT JOIN aucs a ON c.state = a.state
"""


@register("m5_screening_metrics", _SCREEN_SQL)
def m5_screening_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(screening_report(segments(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Linear path: M-4, M-11 (fit), M-9 + P-6 + P-9a + G-* (apply), G-10 (ROC)
# ---------------------------------------------------------------------------

LINEAR_STATE = "AMERICA"      # stand-in for the state the linear model is fitted on

_LIN_ROWS = f"""SELECT state, {label_sql()} AS y, TRY_CAST(Distance_to_Coast_m AS DOUBLE) AS x1,
                TRY_CAST(Inundation_Duration_Min AS DOUBLE) AS x2 FROM segments"""
_LIN_CTES = (
    ("rows_all", f"SELECT * FROM ({_LIN_ROWS}) r WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL"),
    ("stats", f"""SELECT avg(CAST(y AS DOUBLE)) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(x1, x1) AS c11,
                 covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y
                 FROM rows_all WHERE state = '{LINEAR_STATE}'"""),
    ("coef", """SELECT (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1,
                (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2, my, m1, m2 FROM stats"""),
    ("coef2", "SELECT b1, b2, my - (b1 * m1 + b2 * m2) AS b0 FROM coef"),
    ("scored", """SELECT r.state, r.y, b0 + b1 * x1 + b2 * x2 AS score,
                  CAST(b0 + b1 * x1 + b2 * x2 >= 0.5 AS INT) AS y_pred FROM rows_all r CROSS JOIN coef2"""),
)

_LIN_FIT_SQL = with_segments(*_LIN_CTES[:4]) + """
SELECT 'Distance_to_Coast_m' AS Feature, ROUND(b1, 6) AS Coefficient FROM coef2
UNION ALL SELECT 'Inundation_Duration_Min', ROUND(b2, 6) FROM coef2
UNION ALL SELECT 'Intercept', ROUND(b0, 6) FROM coef2
"""

_LIN_METRICS_SQL = with_segments(
    *_LIN_CTES,
    ("counts", counts_sql("scored", ["state"])),
    ("aucs", auc_sql("scored", ["state"])),
) + f"""
SELECT c.state, tn, fp, fn, tp, {', '.join(metrics_select())}, ROUND(a.auc, 6) AS auc
FROM counts c LEFT JOIN aucs a ON c.state = a.state
"""

_LIN_ROC_SQL = with_segments(
    *_LIN_CTES,
    ("sc", "SELECT state, score, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg FROM scored GROUP BY state, score"),
    ("cum", """SELECT state, score, sum(n_pos) OVER (PARTITION BY state ORDER BY score DESC) AS tps,
               sum(n_neg) OVER (PARTITION BY state ORDER BY score DESC) AS fps,
               sum(n_pos) OVER (PARTITION BY state) AS P, sum(n_neg) OVER (PARTITION BY state) AS N FROM sc"""),
) + f"""
SELECT state, ROUND(score, 6) AS threshold, ROUND({div('fps', 'N')}, 6) AS fpr, ROUND({div('tps', 'P')}, 6) AS tpr FROM cum
UNION ALL SELECT DISTINCT state, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM scored
"""


def _linear_model(spark: SparkSession, sf_dir: str):
    from washline.plans.linear import fit_state
    return fit_state(segments(spark, sf_dir), LINEAR_STATE)


@register("m4_m11_linear_fit", _LIN_FIT_SQL)
def m4_m11_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_linear_model(spark, sf_dir).coefficient_table(spark))


@register("m9_linear_metrics", _LIN_METRICS_SQL)
def m9_linear_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.plans.linear import linear_metrics
    out = linear_metrics(segments(spark, sf_dir), _linear_model(spark, sf_dir))
    return round_doubles(out)


@register("g10_linear_roc_curve", _LIN_ROC_SQL)
def g10_linear_roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.plans.linear import linear_roc
    return round_doubles(linear_roc(segments(spark, sf_dir), _linear_model(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Sampling: D-1 holdout, D-2/D-3/D-6/W-4 balanced runs + split, D-5 bounded sample, D-7 folds
# ---------------------------------------------------------------------------

SAMPLE_RUNS = 5               # runs listed row by row; k1_s3_d2_d3_all_runs digests all of the method's runs

_LABELED = f"SELECT state, segment_id, {label_sql()} AS y FROM segments WHERE {label_sql()} IS NOT NULL"
_HOLDOUT_CTES = (
    ("lab", _LABELED),
    ("hq", quota_sql("lab", ["state"], "y", 0.1)),
    ("hr", f"""SELECT l.state, l.segment_id, l.y, row_number() OVER (PARTITION BY l.state, l.y
              ORDER BY {md5_sql('l.segment_id', "'42'")}) AS rk FROM lab l"""),
    ("holdout", """SELECT r.state, r.segment_id, r.y, CASE WHEN r.rk <= q.n_test THEN 'holdout' ELSE 'pool' END AS split
                  FROM hr r JOIN hq q ON r.state = q.state AND r.y = q.y"""),
    ("pool", "SELECT state, segment_id, y FROM holdout WHERE split = 'pool'"),
)

_HOLDOUT_SQL = with_segments(*_HOLDOUT_CTES) + "SELECT state, segment_id, y, split FROM holdout"

_BAL_CTES = _HOLDOUT_CTES + (
    ("runs", f"SELECT CAST(range AS INTEGER) AS run FROM range(0, {SAMPLE_RUNS})"),
    ("npos", "SELECT state, count(*) AS n_pos FROM pool WHERE y = 1 GROUP BY state"),
    ("negr", f"""SELECT p.state, p.segment_id, p.y, r.run, row_number() OVER (PARTITION BY p.state, r.run
                ORDER BY {md5_sql('p.segment_id', 'CAST(r.run AS VARCHAR)')}) AS rk
                FROM pool p CROSS JOIN runs r WHERE p.y = 0"""),
    ("bal", """SELECT p.state, p.segment_id, p.y, r.run FROM pool p CROSS JOIN runs r WHERE p.y = 1
              UNION ALL SELECT n.state, n.segment_id, n.y, n.run FROM negr n JOIN npos c ON n.state = c.state WHERE n.rk <= c.n_pos"""),
    ("bq", quota_sql("bal", ["state", "run"], "y", 0.2)),
    ("br", f"""SELECT b.*, row_number() OVER (PARTITION BY b.state, b.run, b.y
              ORDER BY {md5_sql('b.segment_id', "'split|' || CAST(b.run AS VARCHAR)")}) AS rk FROM bal b"""),
)

_BAL_SQL = with_segments(*_BAL_CTES) + """
SELECT r.state, r.segment_id, r.y, r.run, CASE WHEN r.rk <= q.n_test THEN 'test' ELSE 'train' END AS split
FROM br r JOIN bq q ON r.state = q.state AND r.run = q.run AND r.y = q.y
"""

_SAMPLE_SQL = with_segments() + f"""
SELECT state, segment_id FROM (
  SELECT state, segment_id, row_number() OVER (PARTITION BY state ORDER BY {md5_sql('segment_id', "'0'")}) AS rk FROM segments
) s WHERE rk <= 50
"""

_FOLDS_SQL = with_segments(*_HOLDOUT_CTES) + f"""
SELECT state, segment_id, y, CAST((row_number() OVER (PARTITION BY state, y ORDER BY {md5_sql('segment_id', "'42'")}) - 1) % 5 AS INTEGER) AS fold
FROM pool
"""


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.functions import label_to_binary
    seg = segments(spark, sf_dir)
    return seg.select("state", "segment_id", label_to_binary("Damage_Status").alias("y")).where("y IS NOT NULL")


def _holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1 per state, written once per session (the pool feeds several queries)."""
    from washline.operators.sampling import holdout_split
    key = ("holdout", _sid(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = materialize(holdout_split(_labeled(spark, sf_dir), ["state"]))
    return _CACHE[key]


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir).where("split = 'pool'").drop("split")


@register("d1_holdout_split", _HOLDOUT_SQL)
def d1_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _holdout(spark, sf_dir).select("state", "segment_id", "y", "split")


@register("d2_d3_balanced_run_splits", _BAL_SQL)
def d2_d3_balanced_run_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.sampling import balanced_runs, run_splits
    bal = balanced_runs(_pool(spark, sf_dir), ["state"], SAMPLE_RUNS)
    return run_splits(bal, ["state"]).select("state", "segment_id", "y", "run", "split")


@register("d5_bounded_sample", _SAMPLE_SQL)
def d5_bounded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.sampling import bounded_sample
    return bounded_sample(segments(spark, sf_dir).select("state", "segment_id"), ["state"], 50, seed=0)


_D4_SQL = with_segments(("lab", _LABELED)) + f"""
SELECT state, segment_id, y, CASE WHEN rk <= CAST(ceil(CAST(0.2 AS DOUBLE) * n) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM (SELECT l.*, row_number() OVER (PARTITION BY state ORDER BY {md5_sql('segment_id', "'42'")}) AS rk,
             count(*) OVER (PARTITION BY state) AS n FROM lab l) x
"""


@register("d4_calibration_split", _D4_SQL)
def d4_calibration_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-4: the notebook's unstratified 20 % calibration split of each state's labelled rows."""
    from washline.operators.sampling import exact_split
    return exact_split(_labeled(spark, sf_dir), ["state"], "segment_id", 0.2, 42).select("state", "segment_id", "y", "split")


@register("d7_stratified_folds", _FOLDS_SQL)
def d7_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.sampling import stratified_folds
    return stratified_folds(_pool(spark, sf_dir), ["state"], 5).select("state", "segment_id", "y", "fold")


# ---------------------------------------------------------------------------
# Ensemble path: M-3 exact trees per run, J-5/M-8 scoring, A-1..A-3, C-2..C-5,
# per-run metrics and their summaries G-11..G-15, K-8 report, M-6/C-1 Platt
# ---------------------------------------------------------------------------

ENSEMBLE_STATE = "EUROPE"     # stand-in for the training state of the ensembles
ENSEMBLE_RUNS = S.N_RUNS      # runs of the registered ensemble queries
PRIORS = {"AMERICA": 59 / 75}  # state-specific population prior (the method's TX rule), default 1/6
_FEATS = ["Z_Min", "Distance_to_Coast_m", "Rel_Elev_Min"]


def _ensemble_parts(spark: SparkSession, sf_dir: str):
    """(segments, holdout, trees) for the registered ensemble queries, fitted once per session."""
    from washline.plans.ensemble import fit_tree_runs
    key = (_sid(spark), sf_dir)
    if key not in _CACHE:
        holdout, packed = _ensemble_splits(spark, sf_dir)
        _CACHE[key] = (segments(spark, sf_dir), holdout, fit_tree_runs(packed, _FEATS, 2, 10))
    return _CACHE[key]


def _ensemble_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(holdout, pool rows with all their runs) of the ensembles, drawn once per session."""
    from washline.plans.ensemble import packed_splits
    key = ("ensemble runs", _sid(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = packed_splits(segments(spark, sf_dir), ENSEMBLE_STATE, _FEATS, ENSEMBLE_RUNS)
    return _CACHE[key]


def _ensemble_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The train and test rows of every ensemble run."""
    from washline.operators.sampling import unpacked
    return unpacked(_ensemble_splits(spark, sf_dir)[1])


def _ens_split_ctes() -> list[tuple[str, str]]:
    fcols = ", ".join(_FEATS)
    lab = (f"SELECT state, segment_id, {label_sql()} AS y, {fcols} FROM segments "
           f"WHERE state = '{ENSEMBLE_STATE}' AND {label_sql()} IS NOT NULL")
    return [
        ("elab", lab),
        ("ehq", quota_sql("elab", ["state"], "y", 0.1)),
        ("ehr", f"SELECT l.*, row_number() OVER (PARTITION BY l.state, l.y ORDER BY {md5_sql('l.segment_id', chr(39) + '42' + chr(39))}) AS rk FROM elab l"),
        ("eho", "SELECT r.*, CASE WHEN r.rk <= q.n_test THEN 'holdout' ELSE 'pool' END AS split FROM ehr r JOIN ehq q ON r.state = q.state AND r.y = q.y"),
        ("epool", f"SELECT state, segment_id, y, {fcols} FROM eho WHERE split = 'pool'"),
        ("eruns", f"SELECT CAST(range AS INTEGER) AS run FROM range(0, {ENSEMBLE_RUNS})"),
        ("enpos", "SELECT state, count(*) AS n_pos FROM epool WHERE y = 1 GROUP BY state"),
        ("enegr", f"""SELECT p.*, r.run, row_number() OVER (PARTITION BY p.state, r.run
                     ORDER BY {md5_sql('p.segment_id', 'CAST(r.run AS VARCHAR)')}) AS rk FROM epool p CROSS JOIN eruns r WHERE p.y = 0"""),
        ("ebal", f"""SELECT p.*, r.run FROM epool p CROSS JOIN eruns r WHERE p.y = 1
                    UNION ALL SELECT n.state, n.segment_id, n.y, {', '.join('n.' + f for f in _FEATS)}, n.run
                    FROM enegr n JOIN enpos c ON n.state = c.state WHERE n.rk <= c.n_pos"""),
        ("ebq", quota_sql("ebal", ["state", "run"], "y", 0.2)),
        ("ebr", f"""SELECT b.*, row_number() OVER (PARTITION BY b.state, b.run, b.y
                   ORDER BY {md5_sql('b.segment_id', "'split|' || CAST(b.run AS VARCHAR)")}) AS rk FROM ebal b"""),
        ("etrain", "SELECT r.* FROM ebr r JOIN ebq q ON r.state = q.state AND r.run = q.run AND r.y = q.y WHERE r.rk > q.n_test"),
    ] + cart_ctes("etrain", _FEATS, 2, 10)


_ENS_SCORE_CTES = _ens_split_ctes() + [
    ("allrows", f"SELECT state, segment_id, {label_sql()} AS y, {', '.join(_FEATS)} FROM segments WHERE {label_sql()} IS NOT NULL"),
] + tree_score_ctes("allrows", "trees", _FEATS, ["state", "segment_id", "y"], 2)

_CACHE_SQL = with_segments(*_ens_split_ctes()) + """
SELECT run, node, depth, is_leaf, feature, ROUND(threshold, 6) AS threshold, n, n_pos, ROUND(prob, 6) AS prob FROM trees
"""

_PRIOR = "CASE " + " ".join(f"WHEN state = '{s}' THEN {float(p)!r}" for s, p in PRIORS.items()) + " ELSE 0.16666666666666666 END"
_ENS_PRED_SQL = with_segments(*_ENS_SCORE_CTES, (
    "red", """SELECT state, segment_id, y, avg(p) AS p_mean_raw, stddev_pop(p) AS p_std,
              avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) AS p_vote FROM scored_long GROUP BY state, segment_id, y"""),
) + f"""
SELECT state, segment_id, y, ROUND(p_mean_raw, 6) AS p_mean_raw, ROUND(p_std, 6) AS p_std, ROUND(p_vote, 6) AS p_vote,
  ROUND({expit_sql(logit_sql('p_mean_raw') + ' + (' + logit_sql('(' + _PRIOR + ')') + ' - 0.0)')}, 6) AS p_mean_adj
FROM red
"""

_RUN_METRIC_CTES = [
    ("lp", "SELECT state, run, y, p AS score, CAST(p >= 0.5 AS INT) AS y_pred FROM scored_long"),
    ("rc", counts_sql("lp", ["state", "run"])),
    ("ra", auc_sql("lp", ["state", "run"])),
    ("rm", f"""SELECT c.state, c.run, tn, fp, fn, tp, {', '.join(metrics_select(False)[:-1])}, a.auc
              FROM rc c LEFT JOIN ra a ON c.state = a.state AND c.run = a.run"""),
]
_METRICS = ["accuracy", "balanced_accuracy", "kappa", "auc", "precision_0", "recall_0", "f1_0",
            "precision_1", "recall_1", "f1_1"]

_RUN_SUMMARY_SQL = with_segments(*_ENS_SCORE_CTES, *_RUN_METRIC_CTES) + "SELECT state, " + ", ".join(
    [f"ROUND(avg({m}), 6) AS {m}_mean, ROUND(stddev_pop({m}), 6) AS {m}_std" for m in _METRICS]
    + [f"ROUND(avg({c}), 2) AS {c}_mean_cm, ROUND(stddev_pop({c}), 2) AS {c}_std_cm" for c in ("tn", "fp", "fn", "tp")]
) + " FROM rm GROUP BY state"

_LONG_SUMMARY_SQL = with_segments(*_ENS_SCORE_CTES, *_RUN_METRIC_CTES) + " UNION ALL ".join(
    f"SELECT state, '{m}' AS metric, ROUND(avg({m}), 6) AS mean, ROUND(stddev_samp({m}), 6) AS std FROM rm GROUP BY state"
    for m in _METRICS)

_CLASS_SUMMARY_SQL = with_segments(*_ENS_SCORE_CTES, *_RUN_METRIC_CTES) + " UNION ALL ".join(
    f"""SELECT state, {c} AS class, ROUND(avg(precision_{c}), 6) AS precision_mean, ROUND(stddev_pop(precision_{c}), 6) AS precision_std,
        ROUND(avg(recall_{c}), 6) AS recall_mean, ROUND(stddev_pop(recall_{c}), 6) AS recall_std,
        ROUND(avg(f1_{c}), 6) AS f1_mean, ROUND(stddev_pop(f1_{c}), 6) AS f1_std FROM rm GROUP BY state""" for c in (0, 1))


def _run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of every (state, run), written once per session."""
    from washline.plans.ensemble import evaluate_states
    key = ("run metrics", _sid(spark), sf_dir)
    if key not in _CACHE:
        seg, _, trees = _ensemble_parts(spark, sf_dir)
        _CACHE[key] = materialize(evaluate_states(seg, trees, _FEATS))
    return _CACHE[key]


@register("m3_cart_tree_table", _CACHE_SQL)
def m3_cart_tree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_ensemble_parts(spark, sf_dir)[2])


@register("j5_a1_a3_c4_ensemble_predictions", _ENS_PRED_SQL)
def j5_a1_a3_c4_ensemble_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.plans.ensemble import predict_states
    seg, _, trees = _ensemble_parts(spark, sf_dir)
    pred = predict_states(seg, trees, _FEATS, PRIORS)
    return round_doubles(pred.select("state", "segment_id", "y", "p_mean_raw", "p_std", "p_vote", "p_mean_adj"))


_ENS_LONG_SQL = with_segments(*_ENS_SCORE_CTES) + """
SELECT state, segment_id, ROUND(avg(p), 6) AS p_mean_raw, ROUND(stddev_pop(p), 6) AS p_std,
  ROUND(avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS p_vote FROM scored_long GROUP BY state, segment_id
"""


@register("j5_a1_a3_tree_walk_long", _ENS_LONG_SQL)
def j5_a1_a3_tree_walk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for tree tables too large to inline: whole batches of rows walk broadcast node arrays."""
    from washline.operators.ensemble import reduce_wide
    from washline.operators.trees import score_wide
    from washline.plans.ensemble import labeled
    seg, _, trees = _ensemble_parts(spark, sf_dir)
    wide, runs = score_wide(labeled(seg, _FEATS).select("state", "segment_id", *_FEATS), trees, inline_limit=0)
    red = reduce_wide(wide, [f"p_{r}" for r in runs])
    return round_doubles(red.select("state", "segment_id", "p_mean_raw", "p_std", "p_vote"))


@register("g11_g12_g14_run_summary", _RUN_SUMMARY_SQL)
def g11_g12_g14_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F
    from washline.operators.metrics import confusion_summary, summarize_over_runs
    metrics = _run_metrics(spark, sf_dir)
    summ = summarize_over_runs(metrics, ["state"], std="pop")
    cm = confusion_summary(metrics, ["state"]).select("state", *[F.col(c).alias(f"{c}_cm") for c in
                                                               confusion_summary(metrics, ["state"]).columns if c != "state"])
    return round_doubles(summ.join(cm, "state"))


@register("g13_metric_long_summary", _LONG_SUMMARY_SQL)
def g13_metric_long_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.metrics import long_summary
    metrics = _run_metrics(spark, sf_dir)
    return round_doubles(long_summary(metrics, ["state"], std="samp"))


@register("g15_per_class_summary", _CLASS_SUMMARY_SQL)
def g15_per_class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.metrics import per_class_summary
    metrics = _run_metrics(spark, sf_dir)
    return round_doubles(per_class_summary(metrics, ["state"]))


_CALIB = "(1.0 / (1.0 + exp(-(pl.w * r.p_mean_raw + pl.b))))"
_PLATT_SQL = with_segments(
    *_ENS_SCORE_CTES,
    ("hold_rows", f"SELECT segment_id, y, {', '.join(_FEATS)} FROM eho WHERE split = 'holdout'"),
    *tree_score_ctes("hold_rows", "trees", _FEATS, ["segment_id", "y"], 2, prefix="h"),
    ("hmean", "SELECT segment_id, CAST(y AS DOUBLE) AS y, avg(p) AS x FROM hscored_long GROUP BY segment_id, y"),
    *platt_ctes("hmean"),
    ("red", "SELECT state, segment_id, avg(p) AS p_mean_raw FROM scored_long GROUP BY state, segment_id"),
) + f"""
SELECT r.state, r.segment_id, ROUND(r.p_mean_raw, 6) AS p_mean_raw, ROUND({_CALIB}, 6) AS p_mean_calib,
  ROUND({expit_sql(logit_sql(_CALIB) + ' + (' + logit_sql('(' + _PRIOR + ')') + ' - 0.0)')}, 6) AS p_mean_adj
FROM red r CROSS JOIN platt pl
"""


@register("m6_c1_platt_calibrated_predictions", _PLATT_SQL)
def m6_c1_platt_calibrated_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M-6 (Newton steps, one aggregation each; the oracle unrolls 30 steps), C-1, C-4, C-5."""
    from washline.plans.ensemble import fit_calibration, predict_states
    seg, holdout, trees = _ensemble_parts(spark, sf_dir)
    pred = predict_states(seg, trees, _FEATS, PRIORS, fit_calibration(holdout, trees))
    return round_doubles(pred.select("state", "segment_id", "p_mean_raw", "p_mean_calib", "p_mean_adj"))


# ---------------------------------------------------------------------------
# Spatial + SLR scenarios: F-8, F-10, J-1, J-2, J-3, P-10, P-11, P-12, P-18, P-19a,
# A-4, K-5 shape, R-1..R-8, P-16
# ---------------------------------------------------------------------------

SLR_SCENARIOS = [0.0, 1.2, 1.6, 3.9, 6.1, 8.8, 10.9]
_WET = [s for s in SLR_SCENARIOS if s > 0]

_SPATIAL_CTES = [
    ("pts", "SELECT segment_id, state, x, y, Z_Min, Distance_to_Coast_m, Rel_Elev_Min FROM segments"),
    ("edges", inundation_edges_sql(_WET)),
    ("xing", f"""SELECT e.scenario_ft, p.segment_id, e.poly_id, count(*) FILTER (WHERE {crossing_sql('p.x', 'p.y')}) AS cnt,
                min({seg_dist_sql('p.x', 'p.y')}) AS d
                FROM pts p CROSS JOIN edges e GROUP BY e.scenario_ft, p.segment_id, e.poly_id"""),
    ("wet", "SELECT scenario_ft, segment_id, bool_or(cnt % 2 = 1) AS inside, min(d) AS d FROM xing GROUP BY scenario_ft, segment_id"),
]

_J2_SQL = with_segments(*_SPATIAL_CTES) + "SELECT scenario_ft, segment_id FROM wet WHERE inside"
_J3_SQL = with_segments(*_SPATIAL_CTES) + "SELECT scenario_ft, segment_id, ROUND(d, 6) AS distance FROM wet WHERE NOT inside"

_SC_VALUES = ", ".join(f"(CAST({s!r} AS DOUBLE))" for s in SLR_SCENARIOS)
_SLR_CTES = _ens_split_ctes() + _SPATIAL_CTES + [
    ("fan", f"""SELECT s.scenario_ft, p.segment_id, p.Z_Min,
                CASE WHEN s.scenario_ft > 0 THEN COALESCE(w.inside, FALSE) ELSE FALSE END AS Inundated,
                CASE WHEN s.scenario_ft > 0 THEN (CASE WHEN w.inside THEN NULL ELSE w.d END) ELSE p.Distance_to_Coast_m END AS dist_out,
                p.Rel_Elev_Min AS Rel_Elev_Min_original, p.Rel_Elev_Min - s.scenario_ft * CAST(0.3048 AS DOUBLE) AS Rel_Elev_Min
                FROM pts p CROSS JOIN (VALUES {_SC_VALUES}) s(scenario_ft)
                LEFT JOIN wet w ON w.scenario_ft = s.scenario_ft AND w.segment_id = p.segment_id"""),
    ("model_in", """SELECT *, COALESCE(dist_out, max(dist_out) OVER (PARTITION BY scenario_ft)) AS Distance_to_Coast_m FROM fan"""),
] + tree_score_ctes("model_in", "trees", _FEATS,
                    ["scenario_ft", "segment_id", "Inundated", "dist_out", "Rel_Elev_Min_original", "Rel_Elev_Min", "Z_Min"], 2)
_SLR_CTES = [(n, b) for n, b in _SLR_CTES if n not in ("walk0",)] + [(n, b) for n, b in _SLR_CTES if n == "walk0"]
_SLR_RESULT = """SELECT scenario_ft, segment_id, Inundated, dist_out AS Distance_to_Coast_m, Rel_Elev_Min_original, Rel_Elev_Min, Z_Min,
        CASE WHEN Inundated THEN -0.1 ELSE avg(p) END AS Washout_Probability
        FROM scored_long GROUP BY scenario_ft, segment_id, Inundated, dist_out, Rel_Elev_Min_original, Rel_Elev_Min, Z_Min"""


def _slr_sql(final: str) -> str:
    ctes = list(_SLR_CTES)
    order = [n for n, _ in ctes]
    # walk0 must follow model_in; tree_score_ctes already emits it first among its CTEs
    ctes.sort(key=lambda nb: order.index(nb[0]) if nb[0] != "walk0" else order.index("model_in") + 0.5)
    return with_segments(*ctes, ("slr", _SLR_RESULT)) + final


_SLR_PRED_SQL = _slr_sql("""
SELECT scenario_ft, segment_id, Inundated, ROUND(Distance_to_Coast_m, 6) AS Distance_to_Coast_m,
  ROUND(Rel_Elev_Min_original, 6) AS Rel_Elev_Min_original, ROUND(Rel_Elev_Min, 6) AS Rel_Elev_Min,
  ROUND(Washout_Probability, 6) AS Washout_Probability FROM slr""")

_RISK_CASE = ("CASE WHEN Washout_Probability = -1.0 THEN 'Inundated' WHEN Washout_Probability < 0.33 THEN 'Low' "
              "WHEN Washout_Probability < 0.66 THEN 'Medium' ELSE 'High' END")
_R1_SQL = _slr_sql(f"""
SELECT scenario_ft AS Scenario_ft, {', '.join(f"ROUND(CAST(count(*) FILTER (WHERE {_RISK_CASE} = '{c}') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0, 6) AS {c}" for c in ['Low', 'Medium', 'High', 'Inundated'])}
FROM slr GROUP BY scenario_ft""")

_BINS = {"Low": (0.0, 0.33), "Medium": (0.34, 0.66), "High": (0.67, 1.0), "Inundated": (-0.11, -0.09)}
_R2_INNER = ", ".join(f"CAST(count(*) FILTER (WHERE Washout_Probability >= {lo} AND Washout_Probability <= {hi}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 AS {c}"
                      for c, (lo, hi) in _BINS.items())
_R2_SQL = _slr_sql(f"""
SELECT Scenario_ft, {', '.join(f'ROUND({c} / NULLIF(Low + Medium + High + Inundated, 0) * 100.0, 6) AS {c}' for c in _BINS)},
  ROUND(Scenario_m, 6) AS Scenario_m,
  {', '.join(f'ROUND({c}, 6) AS {c}_raw' for c in _BINS)}
FROM (SELECT scenario_ft AS Scenario_ft, {_R2_INNER}, scenario_ft * CAST(0.3048 AS DOUBLE) AS Scenario_m FROM slr GROUP BY scenario_ft) b""")

_R7_SQL = _slr_sql("""
SELECT scenario_ft, Z_Min, ROUND(avg(Washout_Probability), 6) AS mean_probability FROM slr
WHERE Washout_Probability >= 0 GROUP BY scenario_ft, Z_Min""")


def _slr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("pts", _sid(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = materialize(segments(spark, sf_dir).select(
            "segment_id", "state", "x", "y", "Z_Min", "Distance_to_Coast_m", "Rel_Elev_Min"))
    return _CACHE[key]


def _slr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-2 + J-3 + P-18/P-19a for every scenario (one spatial pass shared by the queries below)."""
    from washline.plans.slr import scenario_features
    from washline.sources.fixtures import inundation_edges
    key = ("slr_feats", _sid(spark), sf_dir)
    if key not in _CACHE:
        edges = materialize(inundation_edges(spark, sf_dir, _WET))
        _CACHE[key] = materialize(scenario_features(_slr_points(spark, sf_dir), edges, SLR_SCENARIOS))
    return _CACHE[key]


def _slr_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.plans.slr import scenario_predictions
    key = ("slr", _sid(spark), sf_dir)
    if key not in _CACHE:
        _, _, trees = _ensemble_parts(spark, sf_dir)
        _CACHE[key] = materialize(scenario_predictions(_slr_features(spark, sf_dir), trees, _FEATS))
    return _CACHE[key]


@register("j2_point_in_polygon", _J2_SQL)
def j2_point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = _slr_features(spark, sf_dir)
    return feats.where((F.col("scenario_ft") > 0) & F.col("Inundated")).select("scenario_ft", "segment_id")


@register("j3_distance_to_polygons", _J3_SQL)
def j3_distance_to_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = _slr_features(spark, sf_dir)
    dry = feats.where((F.col("scenario_ft") > 0) & ~F.col("Inundated"))
    return round_doubles(dry.select("scenario_ft", "segment_id", F.col("Distance_to_Coast_m").alias("distance")))


@register("slr_scenario_predictions", _SLR_PRED_SQL)
def slr_scenario_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _slr_predictions(spark, sf_dir)
    return round_doubles(out.select("scenario_ft", "segment_id", "Inundated", "Distance_to_Coast_m",
                                    "Rel_Elev_Min_original", "Rel_Elev_Min", "Washout_Probability"))


@register("r1_r5_risk_share_summary", _R1_SQL)
def r1_r5_risk_share_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.scenario import risk_share_summary
    out = _slr_predictions(spark, sf_dir).withColumnRenamed("scenario_ft", "Scenario_ft")
    return round_doubles(risk_share_summary(out))


@register("r2_r6_r8_binned_summary", _R2_SQL)
def r2_r6_r8_binned_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.scenario import renormalise, risk_bin_summary
    out = _slr_predictions(spark, sf_dir).withColumnRenamed("scenario_ft", "Scenario_ft")
    raw = risk_bin_summary(out)
    classes = list(_BINS)
    norm = renormalise(raw, classes)
    both = norm.join(raw.select("Scenario_ft", *[F.col(c).alias(f"{c}_raw") for c in classes]), "Scenario_ft")
    return round_doubles(both)


@register("r7_p16_probability_trend", _R7_SQL)
def r7_p16_probability_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.scenario import probability_trend
    return round_doubles(probability_trend(_slr_predictions(spark, sf_dir), keys=["scenario_ft"]))


# ---------------------------------------------------------------------------
# Shapley attribution: X-1 background sample, X-2 exact values (M-5, M-9), X-3 mean over runs,
# X-4 feature ranking, X-5 top-k
# ---------------------------------------------------------------------------

SHAP_RUNS = S.N_RUNS
_SCREEN_F = ["Distance_to_Coast_m", "Rel_Elev_Min", "Z_Min"]
_PATTERN_SQL = ("(CASE WHEN Distance_to_Coast_m <= 48.06 THEN 1 ELSE 0 END + CASE WHEN Rel_Elev_Min <= 1.71 THEN 2 ELSE 0 END"
                " + CASE WHEN Z_Min <= 3.03 THEN 4 ELSE 0 END)")


def _phi_sql() -> str:
    from itertools import combinations
    from math import factorial
    parts = []
    for j in range(3):
        others = [i for i in range(3) if i != j]
        terms = []
        for size in range(3):
            for subset in combinations(others, size):
                s = sum(1 << i for i in subset)
                w = factorial(size) * factorial(3 - size - 1) / factorial(3)
                terms.append(f"{w!r} * (v{s | (1 << j)} - v{s})")
        parts.append(f"SELECT run, xp AS pattern, {j} AS feature_index, {' + '.join(terms)} AS shap FROM vw")
    return " UNION ALL ".join(parts)


_SHAP_CTES = [
    ("complete", f"""SELECT state, segment_id, {_PATTERN_SQL} AS pattern FROM segments
                   WHERE Distance_to_Coast_m IS NOT NULL AND Rel_Elev_Min IS NOT NULL AND Z_Min IS NOT NULL
                   AND Damage_Status IN ('Damage', 'No Damage')"""),
    ("sruns", f"SELECT CAST(range AS INTEGER) AS run FROM range(0, {SHAP_RUNS})"),
    ("bg", f"""SELECT run, pattern FROM (SELECT c.pattern, r.run, row_number() OVER (PARTITION BY r.run
              ORDER BY {md5_sql('c.segment_id', "'bg|' || CAST(r.run AS VARCHAR)")}) AS rk
              FROM complete c CROSS JOIN sruns r WHERE c.state = '{ENSEMBLE_STATE}') x WHERE rk <= 50"""),
    ("bw", "SELECT run, pattern, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY run) AS DOUBLE) AS w FROM bg GROUP BY run, pattern"),
    ("vv", """SELECT b.run, x.xp, c.coal, sum(b.w * CASE WHEN bit_count(CAST(((x.xp & c.coal) | (b.pattern & (7 - c.coal))) AS INTEGER)) >= 2
              THEN 1.0 ELSE 0.0 END) AS v FROM bw b CROSS JOIN (SELECT CAST(range AS INTEGER) AS xp FROM range(8)) x
              CROSS JOIN (SELECT CAST(range AS INTEGER) AS coal FROM range(8)) c GROUP BY b.run, x.xp, c.coal"""),
    ("vw", "SELECT run, xp, " + ", ".join(f"sum(CASE WHEN coal = {s} THEN v END) AS v{s}" for s in range(8)) + " FROM vv GROUP BY run, xp"),
    ("phi", _phi_sql()),
    ("mphi", "SELECT pattern, feature_index, avg(shap) AS shap FROM phi GROUP BY pattern, feature_index"),
    ("rowshap", """SELECT c.state, c.segment_id, CASE m.feature_index WHEN 0 THEN 'Distance_to_Coast_m' WHEN 1 THEN 'Rel_Elev_Min'
                  ELSE 'Z_Min' END AS feature, m.shap FROM complete c JOIN mphi m ON c.pattern = m.pattern"""),
]

_SHAP_SQL = with_segments(*_SHAP_CTES) + "SELECT state, segment_id, feature, ROUND(shap, 6) AS shap FROM rowshap"
_RANK_SQL = with_segments(*_SHAP_CTES) + """
SELECT feature, ROUND(avg(abs(shap)), 6) AS mean_abs_shap FROM rowshap GROUP BY feature"""

_LIN_SHAP_SQL = with_segments(*_LIN_CTES, (
    "lbg", f"""SELECT avg(x1) AS b1m, avg(x2) AS b2m FROM (SELECT x1, x2, row_number() OVER (ORDER BY
               {md5_sql('segment_id', "'bg|0'")}) AS rk FROM (SELECT r.*, s.segment_id FROM (SELECT state, segment_id, {label_sql()} AS y,
               TRY_CAST(Distance_to_Coast_m AS DOUBLE) AS x1, TRY_CAST(Inundation_Duration_Min AS DOUBLE) AS x2 FROM segments) r
               JOIN (SELECT segment_id FROM segments) s USING (segment_id)
               WHERE r.state = '{LINEAR_STATE}' AND r.y IS NOT NULL AND r.x1 IS NOT NULL AND r.x2 IS NOT NULL) q) z WHERE rk <= 50"""),
    ("lrows", f"""SELECT state, segment_id, TRY_CAST(Distance_to_Coast_m AS DOUBLE) AS x1, TRY_CAST(Inundation_Duration_Min AS DOUBLE) AS x2
                 FROM segments WHERE {label_sql()} IS NOT NULL AND Distance_to_Coast_m IS NOT NULL AND Inundation_Duration_Min IS NOT NULL"""),
) + """
SELECT state, segment_id, 'Distance_to_Coast_m' AS feature, ROUND(b1 * (x1 - b1m), 6) AS shap FROM lrows CROSS JOIN coef2 CROSS JOIN lbg
UNION ALL
SELECT state, segment_id, 'Inundation_Duration_Min' AS feature, ROUND(b2 * (x2 - b2m), 6) AS shap FROM lrows CROSS JOIN coef2 CROSS JOIN lbg
"""


def _screening_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.explain import attach_shapley, screening_pattern, screening_shapley_table
    from washline.operators.sampling import fan_out_runs, first_n, md5_key
    from washline.plans.screening import SCREEN_REQUIRED
    from washline.operators.prep import require_complete
    rows = require_complete(segments(spark, sf_dir), SCREEN_REQUIRED)
    src = rows.where(F.col("state") == ENSEMBLE_STATE).select("segment_id", screening_pattern().alias("pattern"))
    fan = fan_out_runs(src, SHAP_RUNS).withColumn("_mk", md5_key("segment_id", F.concat(F.lit("bg|"), F.col("run").cast("string"))))
    bg = first_n(fan.withColumn("_k", F.lit(50)), ["run"], "_mk", "_k")
    table = screening_shapley_table(bg, ["run"]).groupBy("pattern", "feature_index").agg(F.avg("shap").alias("shap"))
    return attach_shapley(rows, table, _SCREEN_F, ["state", "segment_id"])


@register("x2_x3_screening_shapley", _SHAP_SQL)
def x2_x3_screening_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(_screening_shap(spark, sf_dir))


@register("x4_feature_ranking", _RANK_SQL)
def x4_feature_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.explain import feature_ranking
    return round_doubles(feature_ranking(_screening_shap(spark, sf_dir)))


@register("x2_linear_shapley", _LIN_SHAP_SQL)
def x2_linear_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.explain import linear_shapley
    from washline.operators.sampling import bounded_sample
    from washline.plans.linear import linear_rows
    model = _linear_model(spark, sf_dir)
    seg = segments(spark, sf_dir)
    train_rows = linear_rows(seg.where(F.col("state") == LINEAR_STATE), model.features, keep=["segment_id"])
    bg = bounded_sample(train_rows, [], 50, seed="bg|0")
    means = bg.agg(*[F.avg(f).alias(f) for f in model.features]).first().asDict()
    rows = linear_rows(seg, model.features, keep=["state", "segment_id"])
    return round_doubles(linear_shapley(rows, model, means, ["state", "segment_id"]))


# ---------------------------------------------------------------------------
# Preparation: S-2/P-13 per-state tables with missing columns, P-5 align, E-1/E-2 training
# imputation, E-3 category index, P-17 derived elevation, P-15 preview, K-8 report
# ---------------------------------------------------------------------------

SPARSE_STATE = "ASIA"         # this state's table lacks two columns (like the smaller state tables)
_ALIGN_COLS = ["Distance_to_Coast_m", "Z_Min", "Inundation_Duration_Min", "surfc_type", "priority"]

_PREP_SQL = with_segments(
    ("st", f"""SELECT state, segment_id, Distance_to_Coast_m, Z_Min,
              CASE WHEN state = '{SPARSE_STATE}' THEN NULL ELSE Inundation_Duration_Min END AS Inundation_Duration_Min,
              CASE WHEN state = '{SPARSE_STATE}' THEN NULL ELSE surfc_type END AS surfc_type,
              CAST(NULL AS DOUBLE) AS priority FROM segments WHERE {label_sql()} IS NOT NULL"""),
    ("tr", f"SELECT * FROM st WHERE state = '{ENSEMBLE_STATE}'"),
    ("means", "SELECT avg(Distance_to_Coast_m) AS m1, avg(Z_Min) AS m2, avg(Inundation_Duration_Min) AS m3, avg(priority) AS m4 FROM tr"),
    ("modev", "SELECT surfc_type AS md FROM (SELECT surfc_type, count(*) AS c FROM tr WHERE surfc_type IS NOT NULL GROUP BY 1) x ORDER BY c DESC, surfc_type ASC LIMIT 1"),
    ("cats", "SELECT surfc_type AS cat, CAST(row_number() OVER (ORDER BY surfc_type) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT surfc_type FROM tr WHERE surfc_type IS NOT NULL) d"),
    ("imp", """SELECT state, segment_id, COALESCE(Distance_to_Coast_m, m1) AS Distance_to_Coast_m, COALESCE(Z_Min, m2) AS Z_Min,
              COALESCE(Inundation_Duration_Min, m3) AS Inundation_Duration_Min, COALESCE(surfc_type, md) AS surfc_type,
              COALESCE(priority, m4) AS priority FROM st CROSS JOIN means CROSS JOIN modev"""),
) + """
SELECT i.state, i.segment_id, ROUND(i.Distance_to_Coast_m, 6) AS Distance_to_Coast_m, ROUND(i.Z_Min, 6) AS Z_Min,
  ROUND(i.Inundation_Duration_Min, 6) AS Inundation_Duration_Min, i.surfc_type, ROUND(i.priority, 6) AS priority, c.idx AS surfc_type_index
FROM imp i LEFT JOIN cats c ON i.surfc_type = c.cat
"""


@register("p5_e1_e2_e3_align_impute_encode", _PREP_SQL)
def p5_e1_e2_e3_align_impute_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.functions import label_to_binary
    from washline.operators.prep import align_schema, apply_imputer, category_table, encode_with_table, fit_imputer
    seg = segments(spark, sf_dir).where(label_to_binary("Damage_Status").isNotNull())
    # S-2: one state's table lacks two columns; in the union of the states they are NULL there
    lacks = F.col("state").eqNullSafe(F.lit(SPARSE_STATE))
    union = seg.select("state", "segment_id", "Distance_to_Coast_m", "Z_Min",
                       *[F.when(~lacks, F.col(c)).alias(c) for c in ("Inundation_Duration_Min", "surfc_type")])
    aligned = align_schema(union, _ALIGN_COLS, keep=["state", "segment_id"])                 # P-5
    train = aligned.where(F.col("state") == ENSEMBLE_STATE)
    fills = fit_imputer(train, [c for c in _ALIGN_COLS if c != "surfc_type"], ["surfc_type"])  # E-1, E-2
    out = encode_with_table(apply_imputer(aligned, fills), "surfc_type", category_table(train, "surfc_type"))  # E-3
    return round_doubles(out)


_E3_SQL = """
WITH cats AS (SELECT c_name AS cat, CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS idx
              FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 2 = 0) d)
SELECT o_orderkey, c_name, idx AS c_name_index FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN cats ON c_name = cat
"""


@register("e3_large_domain_index", _E3_SQL)
def e3_large_domain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-3 over a domain that grows with the data: the training domain is every other customer name."""
    from washline.operators.prep import category_table, encode_with_table
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    named = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("o_orderkey", "c_name")
    return encode_with_table(named, "c_name", category_table(customers.where(F.col("c_custkey") % 2 == 0), "c_name"))


_SPLIT_KEYS = "nation, segment, priority"
_SMALL_GROUPS = f"""
WITH rows AS (SELECT o_orderkey AS id, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS nation, c_mktsegment AS segment,
    o_orderpriority AS priority, CAST(o_orderkey % 10 = 3 AS INTEGER) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT {_SPLIT_KEYS}, y, count(*) AS nc FROM rows GROUP BY ALL),
total AS (SELECT *, sum(nc) OVER (PARTITION BY {_SPLIT_KEYS}) AS n FROM counts),
share AS (SELECT *, n - CAST(ceil(0.1 * n) AS BIGINT) AS n_train, CAST(nc AS DOUBLE) / n * (n - CAST(ceil(0.1 * n) AS BIGINT)) AS cont FROM total),
floors AS (SELECT *, CAST(floor(cont) AS BIGINT) AS fl, cont - CAST(floor(cont) AS BIGINT) AS rem FROM share),
quota AS (SELECT {_SPLIT_KEYS}, y, nc - fl - CASE WHEN row_number() OVER (PARTITION BY {_SPLIT_KEYS} ORDER BY rem DESC, nc DESC, y)
    <= n_train - sum(fl) OVER (PARTITION BY {_SPLIT_KEYS}) THEN 1 ELSE 0 END AS n_test FROM floors),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {_SPLIT_KEYS}, y ORDER BY md5(CAST(id AS VARCHAR) || '|42')) AS rk FROM rows)
SELECT r.id, r.nation, r.segment, r.priority, r.y, CASE WHEN rk <= n_test THEN 'holdout' ELSE 'pool' END AS split
FROM ranked r JOIN quota q ON r.nation IS NOT DISTINCT FROM q.nation AND r.segment = q.segment AND r.priority = q.priority AND r.y = q.y
"""


@register("d1_small_groups_holdout", _SMALL_GROUPS)
def d1_small_groups_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1 over many tiny groups, some of one row or one class, and a NULL group key."""
    from washline.operators.sampling import holdout_split
    t = lambda n, *c: spark.read.parquet(f"{sf_dir}/{n}.parquet").select(*c)
    rows = (t("orders", "o_orderkey", "o_custkey", "o_orderpriority")
            .join(t("customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
            .join(t("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    rows = rows.select(F.col("o_orderkey").alias("id"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("nation"),
                       F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"),
                       (F.col("o_orderkey") % 10 == 3).cast("int").alias("y"))
    return holdout_split(rows, ["nation", "segment", "priority"], "y", "id")


_P17_SQL = with_segments() + """
SELECT segment_id, ROUND(Z_Min - Max_Height, 6) AS Rel_Elev_Min, ROUND(Z_Max - Max_Height, 6) AS Rel_Elev_Max,
  ROUND(Z_Min - 2.0 * CAST(0.3048 AS DOUBLE), 6) AS Z_Min_2ft, ROUND(TRY_CAST(Inundation_Duration_Min AS DOUBLE), 6) AS Inundation_Duration_Min
FROM segments
"""


@register("p17_p19b_derived_features", _P17_SQL)
def p17_p19b_derived_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.functions import feet_to_m, to_number
    from washline.operators.prep import derive_relative_elevation
    seg = segments(spark, sf_dir).select("segment_id", "Z_Min", "Z_Max", "Max_Height", "Inundation_Duration_Min")
    d = derive_relative_elevation(seg)
    return round_doubles(d.select("segment_id", "Rel_Elev_Min", "Rel_Elev_Max",
                                  (F.col("Z_Min") - feet_to_m(F.lit(2.0))).alias("Z_Min_2ft"),
                                  to_number("Inundation_Duration_Min").alias("Inundation_Duration_Min")))


_P15_SQL = _slr_sql("""
SELECT segment_id, Inundated, ROUND(Distance_to_Coast_m, 6) AS Distance_to_Coast_m, ROUND(Washout_Probability, 6) AS Washout_Probability
FROM slr WHERE scenario_ft = 1.2 ORDER BY segment_id LIMIT 5""")


@register("p15_scenario_preview", _P15_SQL)
def p15_scenario_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.prep import preview
    out = _slr_predictions(spark, sf_dir).where(F.col("scenario_ft") == 1.2)
    return round_doubles(preview(out, ["segment_id", "Inundated", "Distance_to_Coast_m", "Washout_Probability"], ["segment_id"]))


_K8_SQL = with_segments(*_ENS_SCORE_CTES, *_RUN_METRIC_CTES) + "SELECT state, " + ", ".join(
    f"printf('%.3f ± %.3f', avg({m}), stddev_pop({m})) AS {m}" for m in ["accuracy", "balanced_accuracy", "kappa", "auc"]
) + " FROM rm GROUP BY state"


@register("k8_mean_std_report", _K8_SQL)
def k8_mean_std_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from washline.operators.metrics import summarize_over_runs
    from washline.sources.sinks import report_mean_std
    metrics = _run_metrics(spark, sf_dir)
    ms = ["accuracy", "balanced_accuracy", "kappa", "auc"]
    return report_mean_std(summarize_over_runs(metrics, ["state"], ms, std="pop"), ms, ["state"])


# ---------------------------------------------------------------------------
# pyspark.ml model families (rows-only checks): M-3 tree, M-7, M-8, M-10 grid search, K-7 persistence
# (the forests are in plans/forests.py)
# ---------------------------------------------------------------------------

ML_RUNS = 2
_ML_NUM = ["Distance_to_Coast_m", "Z_Min", "Z_Max", "Max_Height", "Rel_Elev_Min", "Inundation_Duration_Min"]
_ML_STR = ["surfc_type"]


def _ml_runs(spark: SparkSession, sf_dir: str):
    from washline.plans.ensemble import training_splits
    key = ("ml", _sid(spark), sf_dir)
    if key not in _CACHE:
        seg = segments(spark, sf_dir)
        rows = seg.select("state", "segment_id", "Damage_Status", *_ML_NUM, *_ML_STR)
        _, runs = training_splits(rows, ENSEMBLE_STATE, _ML_NUM, ML_RUNS, _ML_STR)
        _CACHE[key] = (seg, runs)
    return _CACHE[key]


def _ml_family_metrics(spark: SparkSession, sf_dir: str, spec, numeric, strings) -> DataFrame:
    from washline.operators.metrics import per_group_metrics
    from washline.operators.models import fit_runs, score_runs
    from washline.plans.ensemble import labeled
    seg, runs = _ml_runs(spark, sf_dir)
    models = fit_runs(runs.where("split = 'train'"), list(range(ML_RUNS)), numeric, strings, spec, "y")
    rows = labeled(seg, numeric, strings)
    long = score_runs(rows, models, ["state", "segment_id", "y"])
    long = long.withColumn("y_pred", (F.col("p") >= 0.5).cast("int"))
    return round_doubles(per_group_metrics(long, ["state", "run"], "y", "y_pred", "p"))


@register("m3_ml_decision_tree_run_metrics")
def m3_ml_decision_tree_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows-only: pyspark.ml decision tree, depth 2, at least 10 rows per child."""
    from washline.operators.models import FitSpec
    return _ml_family_metrics(spark, sf_dir, FitSpec("tree", 1, 2, min_leaf=10), _FEATS, [])


@register("m10_grid_search")
def m10_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 288 points of the decision tree grid x 5 folds on one balanced training sample: mean F1 of the damage class, and the best point."""
    from washline.operators.grid import grid_search
    from washline.operators.sampling import stratified_folds
    from washline.plans.ensemble import training_splits
    # a run's draw and split do not depend on the other runs, nor on the ensemble's trees
    _, runs = training_splits(segments(spark, sf_dir), ENSEMBLE_STATE, _FEATS, 1)
    train = stratified_folds(runs.where("split = 'train'"), [], 5)
    return round_doubles(grid_search(train, _FEATS), 9)


from washline.plans import attribution, forests, preparation, second_area, storage  # noqa: E402, F401  (they register their queries)
