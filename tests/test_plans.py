"""Plan discipline of every registered query: no cartesian products, no nested-loop joins,
no Python UDFs; the segment scan reads only the columns it needs."""

import pytest

from tests.conftest import SF

#: 40,000 trees or library fits: tests/test_forests.py and tests/test_tree_shapley.py run the same code on small tables
SLOW_ML = {"m1_full_forest_run_metrics", "m2_three_feature_forest_run_metrics", "m3_ml_decision_tree_run_metrics", "m10_grid_search",
           "d8_bootstrap_counts", "e6_run_preprocessors", "m2_forest_node_table", "j5_forest_predictions", "x5_full_forest_top_features"}
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"]
#: Queries whose work is in whole Arrow batches (node arrays, Shapley tables) by design
ARROW = {"j5_a1_a3_tree_walk_long", "x2_fitted_tree_shapley"}


def _plans():
    from washline.plans import catalog      # the text operators have their own tests
    return sorted(n for n in catalog.queries() if n not in SLOW_ML)


@pytest.mark.parametrize("name", _plans())
def test_no_cross_or_python_operators(spark, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN + ([] if name in ARROW else ["MapInArrow", "MapInPandas"]):
        assert op not in plan, f"{name}: {op}"


def test_segment_scan_is_pruned(spark):
    from washline.plans.screening import screen
    from washline.sources.fixtures import segments
    df = screen(segments(spark, SF), keep=["state"]).groupBy("state", "y", "y_pred").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan and "p_retailprice" not in plan
