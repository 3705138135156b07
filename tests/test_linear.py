"""Linear model goldens: fit on the TX table of two features, apply to NH, RI."""

import os

import pytest

from tests.conftest import DATA
from washline.plans.linear import fit_linear, linear_metrics
from washline.sources.roads import read_road_table


@pytest.fixture(scope="module")
def model(spark):
    webb = read_road_table(spark, os.path.join(DATA, "webb.csv"))
    return fit_linear(webb)


def test_ols_coefficients(model):
    assert model.intercept == pytest.approx(1.00369862, abs=1e-7)
    assert model.coefficients[0] == pytest.approx(-0.00278483394, rel=1e-7)
    assert model.coefficients[1] == pytest.approx(0.0000878314439, rel=1e-6)


def test_linear_metrics(spark, model, states):
    from pyspark.sql import functions as F
    webb = read_road_table(spark, os.path.join(DATA, "webb.csv")).withColumn("state", F.lit("TXW"))
    both = states.unionByName(webb, allowMissingColumns=True)
    got = {r["state"]: r for r in linear_metrics(both, model).collect()}
    gold = {
        "TXW": (8, 13, 1, 75, 0.8557, 0.6839, 0.4637, 0.9496),
        "NH": (17, 18, 1, 6, 0.5476, 0.6714, 0.1739, 0.8245),
        "RI": (24, 16, 5, 3, 0.5625, 0.4875, -0.0161, 0.3344),
    }
    for st, (tn, fp, fn, tp, acc, bal, kap, auc) in gold.items():
        r = got[st]
        assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp), st
        assert r.accuracy == pytest.approx(acc, abs=1e-4)
        assert r.balanced_accuracy == pytest.approx(bal, abs=1e-4)
        assert r.kappa == pytest.approx(kap, abs=1e-4)
        assert r.auc == pytest.approx(auc, abs=1e-4)
    assert got["TXW"].f1_1 == pytest.approx(0.9146, abs=1e-4)
