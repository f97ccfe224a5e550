from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkscreen.functions import exprs, scores


def value(spark, c, **inputs):
    names = list(inputs)
    df = spark.createDataFrame([tuple(inputs[n] for n in names)] if names else [(1.0,)], ", ".join(f"{n} double" for n in names or ["one"]))
    return df.select(c.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


@pytest.mark.parametrize(("up", "down", "want"), [(None, None, (None, False)), (0.0, 0.0, (50.0, True)), (3.0, 1.0, (75.0, True)), (None, 2.0, (0.0, True)), (-1.0, 0.0, (50.0, True))])
def test_eps_revisions(spark, up, down, want):
    assert tuple(value(spark, c, u=up, d=down) for c in scores.eps_revisions(F.col("u"), F.col("d"))) == want


def test_missing_critical_component_lowers_coverage(spark):
    score, coverage = exprs.weighted([(lit(None), 35), (lit(80.0), 30)])
    assert value(spark, score) == 80 and value(spark, coverage) < 70


def test_weighted_score_is_clipped_and_complete(spark):
    score, coverage = exprs.weighted([(lit(120.0), 50), (lit(-10.0), 50)])
    assert value(spark, score) == 55 and value(spark, coverage) == 100


def test_no_component_gives_no_score(spark):
    score, coverage = exprs.weighted([(lit(None), 35), (lit(None), 30)])
    assert value(spark, score) is None and value(spark, coverage) == 0


def test_full_coverage_is_exact(spark):
    _, coverage = exprs.weighted([(lit(1.0), w) for w in scores.LONG_WEIGHTS.values()])
    assert value(spark, coverage) == 100.0


def test_momentum_prefers_health(spark):
    assert value(spark, scores.momentum(lit(6.0), lit(15.0))) == 100 > value(spark, scores.momentum(lit(25.0), lit(60.0)))


@pytest.mark.parametrize(("x", "want"), [(-6.0, 100.0), (0.0, 55.0), (-35.0, 0.0), (-90.0, 0.0), (9.0, 55.0), (None, None)])
def test_pullback(spark, x, want):
    assert value(spark, exprs.piecewise(F.col("x"), scores.PULLBACK), x=x) == want


@pytest.mark.parametrize(("nxt", "last", "want"), [(2.0, None, 10.0), (30.0, None, 77.5), (None, None, None), (-1.0, 1.0, 35.0), (-1.0, 45.0, 95.0)])
def test_earnings_timing(spark, nxt, last, want):
    assert value(spark, scores.earnings_timing(F.col("n"), F.col("s")), n=nxt, s=last) == want


def test_coverage_multiplier(spark):
    assert value(spark, scores.coverage_multiplier(lit(0.75))) == pytest.approx(0.925)


@pytest.mark.parametrize(
    ("lt", "st", "want"),
    [
        (82.0, 18.0, "ATTRACTIVE BUT TECHNICALLY WEAK"),
        (82.0, 52.0, "ATTRACTIVE, WAIT FOR ENTRY"),
        (82.0, 78.0, "STRONG CANDIDATE"),
        (67.0, 81.0, "TACTICAL CANDIDATE"),
        (54.0, 80.0, "MOMENTUM ONLY"),
        (None, 80.0, "TECHNICAL ONLY"),
        (80.0, None, "ANALYST VIEW ONLY"),
        (70.0, 70.0, "RESEARCH CANDIDATE"),
        (None, None, "INSUFFICIENT DATA"),
        (10.0, 10.0, "LOW PRIORITY"),
    ],
)
def test_candidate_profile(spark, lt, st, want):
    assert value(spark, scores.candidate_profile(F.col("a"), F.col("b")), a=lt, b=st) == want


@pytest.mark.parametrize(("r2", "red", "worst", "want"), [(1.0, 1.0, None, (94.0, 75.0, "PARTIAL_DATA")), (None, None, None, (None, 0.0, "INSUFFICIENT_DATA")), (1.0, 0.0, -1.0, (100.0, 100.0, "RANKED"))])
def test_selloff_stability(spark, r2, red, worst, want):
    got = tuple(value(spark, x, a=r2, b=red, w=worst) for x in scores.selloff_stability(F.col("a"), F.col("b"), F.col("w")))
    assert got[0] == (pytest.approx(want[0]) if want[0] is not None else None) and got[1:] == want[1:]


ALL_KNOTS = [scores.UPSIDE, scores.AGREEMENT, scores.LONG_TREND, scores.COVERAGE, scores.MOMENTUM_5D, scores.MOMENTUM_20D, scores.MA_DISTANCE, scores.SELLOFF_2D, scores.RED_DAYS, scores.WORST_DAY, scores.VOLATILITY, scores.SECTOR_VOLATILITY, scores.NEXT_EARNINGS, scores.LAST_EARNINGS]


@pytest.mark.parametrize("knots", ALL_KNOTS)
def test_knots_midpoints_and_ends(spark, knots):
    points = [(float(x), float(y)) for x, y in knots]
    points += [((a + c) / 2, (b + d) / 2) for (a, b), (c, d) in zip(points[:-1], points[1:], strict=True)]
    points += [(points[0][0] - 5, float(knots[0][1])), (float(knots[-1][0]) + 5, float(knots[-1][1]))]
    df = spark.createDataFrame(points, "x double, y double").select(exprs.piecewise(F.col("x"), knots).alias("v"), "y")
    assert all(r["v"] == pytest.approx(r["y"]) for r in df.collect())


@pytest.mark.parametrize(("raw", "want"), [("12.5", 12.5), (" 7 ", 7.0), ("", None), ("abc", None), ("inf", None), ("NaN", None), ("1e400", None), (None, None)])
def test_finite(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(exprs.finite(F.col("x")).alias("v")).first()["v"] == want
