"""Confidence and risk formulas."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import confidence, risk

FINDING = "finding_id int, reproduced boolean, reachable boolean, corroborating_agents int, contradictions int, verification string, static_suspect boolean, is_hypothesis boolean"


def scores(spark, rows, evidence):
    findings = spark.createDataFrame(rows, FINDING)
    items = spark.createDataFrame(evidence, "finding_id int, source_type string, confidence double")
    return {r.finding_id: r.confidence for r in confidence.with_confidence(findings, items).collect()}


def test_confidence_orders_caps_and_bounds(spark):
    plain = (None, None, 0, 0, None, None, False)
    rows = [
        (1, *plain),
        (2, *plain),
        (3, True, True, 5, 0, "verified", None, False),
        (4, None, None, 0, 0, "rejected", None, False),
        (5, None, None, 0, 0, None, None, True),
        (6, None, False, 0, 3, None, True, False),
        (7, *plain),
    ]
    evidence = [(1, "static_analysis", 0.9), (2, "static_analysis", 0.9), (2, "benchmark", 0.9)]
    evidence += [(i, "test", 1.0) for i in (3, 4, 5, 6)]
    got = scores(spark, rows, evidence)
    assert got[1] == pytest.approx(0.585)
    assert got[2] == pytest.approx(min(0.95, 1 - (1 - 0.585) * (1 - 0.92 * 0.9)), abs=1e-3)
    assert got[3] == 0.99
    assert got[4] == 0.10
    assert got[5] == 0.40
    assert got[6] == pytest.approx(0.88 - 0.25 - 0.30 - 0.10, abs=1e-3)
    assert got[7] == 0.15


def test_risk_formula_and_priorities(spark):
    rows = [("critical", 0.99, 1.0, 0.8, 1.0), ("high", 0.8, 1.0, 0.8, 1.5), ("info", 0.5, 0.3, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "severity string, confidence double, impact_value double, exploitability_value double, multiplier double")
    got = {r.severity: r for r in risk.with_score(df).collect()}
    assert got["critical"].score == 82.5 and got["critical"].priority == "P0"
    assert got["high"].raw == pytest.approx(0.72)
    assert got["info"].priority == "P4"


def test_overall_risk_is_dominated_by_the_worst(spark):
    df = spark.createDataFrame([("a", s) for s in (90.0, 40.0, 40.0, 40.0)] + [("b", 10.0)], "repo_id string, score double")
    got = {r.repo_id: r for r in risk.overall_risk(df).collect()}
    assert got["a"].overall_score == 93.2 and got["a"].level == "critical"
    assert got["b"].level == "minimal"


def test_saturation_is_monotonic(spark):
    df = spark.range(0, 50).select(risk.normalise(F.col("id") / 20).alias("s"), "id").orderBy("id")
    values = [r.s for r in df.collect()]
    assert values == sorted(values)
    assert values[20] == pytest.approx(100 * (1 - math.exp(-2.2)), abs=0.05)
