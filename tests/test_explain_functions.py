"""Shapley efficiency, scalar functions, entry contract."""

import math

import pytest
from pyspark.sql import functions as F

from washline.functions import expit, logit, prior_shift, risk_class, utm_project
from washline.operators.explain import screening_pattern, screening_shapley_table


def test_shapley_efficiency(spark):
    bg = spark.createDataFrame([(0, p) for p in [0, 1, 3, 3, 5, 6, 7, 2, 4]], "run int, pattern int")
    table = {(r.pattern, r.feature_index): r.shap for r in screening_shapley_table(bg, ["run"]).collect()}
    pats = [0, 1, 3, 3, 5, 6, 7, 2, 4]
    f = lambda b: 1.0 if bin(b).count("1") >= 2 else 0.0
    ef = sum(f(p) for p in pats) / len(pats)
    for xp in range(8):
        assert sum(table[(xp, j)] for j in range(3)) == pytest.approx(f(xp) - ef, abs=1e-12)


def test_logit_expit_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.25,)], "p double")
    r = df.select(logit("p").alias("l"), expit(logit("p")).alias("e"), prior_shift("p", 1 / 6).alias("s")).collect()
    assert r[0].l == -math.inf and r[1].l == math.inf
    assert r[0].e == 0.0 and r[1].e == 1.0 and r[2].e == pytest.approx(0.25)
    assert r[0].s == 0.0 and r[1].s == 1.0
    lo = math.log(0.25 / 0.75) + math.log((1 / 6) / (5 / 6))
    assert r[2].s == pytest.approx(1 / (1 + math.exp(-lo)))


def test_risk_classes_and_gaps(spark):
    vals = [-1.0, -0.1, 0.0, 0.329, 0.33, 0.335, 0.65, 0.66, 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(risk_class("p")).collect()]
    assert got == ["Inundated", "Low", "Low", "Low", "Medium", "Medium", "Medium", "High", "High", "High"]


def test_utm_central_meridian(spark):
    df = spark.createDataFrame([(-69.0, 45.0), (-70.5, 43.5)], "x double, y double")
    e, n = utm_project()
    r = df.select(e.alias("e"), n.alias("n")).collect()
    assert r[0].e == pytest.approx(500000.0, abs=1e-6)
    assert r[0].n == pytest.approx(4982950.40, abs=0.05)
    assert 370000 < r[1].e < 390000 and 4810000 < r[1].n < 4830000


def test_entry_and_catalog(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 1
    assert set(E.oracle_sql()) <= set(E.queries())
