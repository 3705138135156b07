"""Screening tree goldens recomputed from the shipped state tables."""

import pytest
from pyspark.sql import functions as F

from washline.plans.screening import screening_report

GOLD = {
    # state: (tn, fp, fn, tp, accuracy, balanced, kappa, auc)
    "NH": (16, 19, 3, 4, 0.4762, 0.5143, 0.0149, 0.5143),
    "RI": (40, 0, 8, 0, 0.8333, 0.5, 0.0, 0.5),
    "TX": (0, 16, 0, 59, 0.7867, 0.5, 0.0, 0.5),
}


def test_screening_goldens(states):
    rep = {r["state"]: r for r in screening_report(states).collect()}
    for st, (tn, fp, fn, tp, acc, bal, kap, auc) in GOLD.items():
        r = rep[st]
        assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)
        assert r.accuracy == pytest.approx(acc, abs=1e-4)
        assert r.balanced_accuracy == pytest.approx(bal, abs=1e-4)
        assert r.kappa == pytest.approx(kap, abs=1e-4)
        assert r.auc == pytest.approx(auc, abs=1e-4)
    pooled = rep["ALL"]
    assert (pooled.tn, pooled.fp, pooled.fn, pooled.tp) == (56, 35, 11, 63)


def test_screening_tree_matches_nested_rule(spark):
    """The 'two of three' form equals the eight leaves of the nested tree."""
    from itertools import product
    from washline.functions import screening_predict
    rows = [(d, r, z) for d, r, z in product([10.0, 100.0], [1.0, 5.0], [1.0, 5.0])]
    df = spark.createDataFrame(rows, "Distance_to_Coast_m double, Rel_Elev_Min double, Z_Min double")
    got = {(r[0], r[1], r[2]): r[3] for r in df.select("*", screening_predict().alias("p")).collect()}

    def nested(d, r, z):
        if d <= 48.06:
            if r <= 1.71:
                return 1
            return 1 if z <= 3.03 else 0
        if r <= 1.71:
            return 1 if z <= 3.03 else 0
        return 0
    for k, v in got.items():
        assert v == nested(*k)


def test_csv_traps(spark):
    """BOM, duplicate header, case-only duplicate names survive the scan."""
    import os
    from tests.conftest import DATA
    from washline.sources.roads import read_road_table
    nh = read_road_table(spark, os.path.join(DATA, "NH.csv"))
    assert "Shape_Leng" in nh.columns and nh.count() == 42
    assert "SHAPE_Leng__1" in nh.columns
    assert nh.where(F.col("Shape_Leng").isNull()).count() == 0
    ri = read_road_table(spark, os.path.join(DATA, "RI.csv"))
    assert ri.count() == 48 and len(ri.columns) == 48
    assert ri.columns[0] == "OBJECTID" or not ri.columns[0].startswith("﻿")
    tx = read_road_table(spark, os.path.join(DATA, "TX.csv"))
    assert tx.count() == 75 and len(tx.columns) == 45
