"""Knots and weights, written down here once more, so that a changed constant fails."""

from __future__ import annotations

from sparkscreen.functions import scores

# Fixed values: (input, score) of each curve, and weights in per cent.
KNOTS = {
    "UPSIDE": ((-30, 0), (-10, 10), (0, 30), (10, 50), (25, 70), (40, 85), (60, 100)),
    "AGREEMENT": ((15, 100), (25, 85), (40, 65), (60, 35), (80, 0)),
    "LONG_TREND": ((-30, 10), (-20, 25), (-10, 45), (0, 65), (10, 85), (20, 100), (35, 80), (50, 50)),
    "COVERAGE": ((5, 60), (10, 75), (15, 85), (20, 92), (30, 100)),
    "MOMENTUM_5D": ((-15, 0), (-10, 10), (-5, 35), (0, 60), (3, 85), (6, 100), (10, 80), (15, 50), (25, 20)),
    "MOMENTUM_20D": ((-25, 0), (-15, 20), (-5, 45), (0, 60), (8, 85), (15, 100), (25, 75), (40, 40), (60, 20)),
    "MA_DISTANCE": ((-15, 10), (-10, 25), (-5, 45), (0, 70), (3, 90), (6, 100), (10, 80), (15, 55), (25, 25)),
    "SELLOFF_2D": ((-10, 0), (-6, 25), (-3, 55), (-1, 80), (1, 100), (4, 85)),
    "RED_DAYS": ((0, 100), (1, 85), (2, 65), (3, 40), (4, 20), (5, 0)),
    "WORST_DAY": ((-10, 0), (-6, 30), (-4, 55), (-2, 80), (-1, 100)),
    "PULLBACK": ((-35, 0), (-25, 15), (-18, 45), (-12, 75), (-8, 95), (-6, 100), (-4, 90), (-2, 70), (0, 55)),
    "VOLATILITY": ((20, 100), (35, 80), (50, 55), (65, 30), (80, 5)),
    "SECTOR_VOLATILITY": ((0, 100), (20, 90), (40, 75), (60, 55), (80, 30), (100, 5)),
    "NEXT_EARNINGS": ((0, 10), (3, 10), (7, 30), (14, 55), (21, 70), (45, 90), (46, 100)),
    "LAST_EARNINGS": ((0, 35), (1, 35), (5, 60), (15, 85), (45, 95)),
}
LONG_WEIGHTS = {"upside": 35, "sentiment": 30, "eps_revisions": 20, "target_agreement": 10, "long_trend": 5}
SHORT_WEIGHTS = {"momentum": 25, "ma_alignment": 25, "pullback_quality": 20, "selloff_stability": 15, "volatility": 10, "earnings_timing": 5}


def test_knots_and_weights():
    for name, want in KNOTS.items():
        assert tuple((float(x), float(y)) for x, y in getattr(scores, name)) == tuple((float(x), float(y)) for x, y in want), name
    assert (dict(scores.LONG_WEIGHTS), dict(scores.SHORT_WEIGHTS)) == (LONG_WEIGHTS, SHORT_WEIGHTS)
    assert (tuple(scores.MOMENTUM_WEIGHTS), tuple(scores.MA_WEIGHTS), tuple(scores.SELLOFF_WEIGHTS)) == ((65, 35), (60, 40), (45, 30, 25))


def test_labels():
    assert [(b, n) for b, n in scores.LONG_CATEGORIES] == [(45, "WEAK"), (60, "NEUTRAL"), (75, "POSITIVE"), (None, "STRONG")]
    assert [(b, n) for b, n in scores.SHORT_CATEGORIES] == [(40, "WAIT / AVOID"), (60, "NEUTRAL"), (75, "WATCH"), (None, "FAVORABLE ENTRY")]
    assert dict(scores.PRIORITIES) == {"STRONG CANDIDATE": 1, "TACTICAL CANDIDATE": 2, "RESEARCH CANDIDATE": 3}
