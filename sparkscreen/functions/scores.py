"""Component scores, each 0..100 or NULL if its inputs are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import INSUFFICIENT, PARTIAL, RANKED
from .exprs import clip, piecewise, weighted

# Knots (input, score) and weights in per cent, which results depend on.
UPSIDE = ((-30, 0), (-10, 10), (0, 30), (10, 50), (25, 70), (40, 85), (60, 100))
AGREEMENT = ((15, 100), (25, 85), (40, 65), (60, 35), (80, 0))
LONG_TREND = ((-30, 10), (-20, 25), (-10, 45), (0, 65), (10, 85), (20, 100), (35, 80), (50, 50))
COVERAGE = ((5, 60), (10, 75), (15, 85), (20, 92), (30, 100))
MOMENTUM_5D = ((-15, 0), (-10, 10), (-5, 35), (0, 60), (3, 85), (6, 100), (10, 80), (15, 50), (25, 20))
MOMENTUM_20D = ((-25, 0), (-15, 20), (-5, 45), (0, 60), (8, 85), (15, 100), (25, 75), (40, 40), (60, 20))
MA_DISTANCE = ((-15, 10), (-10, 25), (-5, 45), (0, 70), (3, 90), (6, 100), (10, 80), (15, 55), (25, 25))
SELLOFF_2D = ((-10, 0), (-6, 25), (-3, 55), (-1, 80), (1, 100), (4, 85))
RED_DAYS = ((0, 100), (1, 85), (2, 65), (3, 40), (4, 20), (5, 0))
WORST_DAY = ((-10, 0), (-6, 30), (-4, 55), (-2, 80), (-1, 100))
PULLBACK = ((-35, 0), (-25, 15), (-18, 45), (-12, 75), (-8, 95), (-6, 100), (-4, 90), (-2, 70), (0, 55))
VOLATILITY = ((20, 100), (35, 80), (50, 55), (65, 30), (80, 5))
SECTOR_VOLATILITY = ((0, 100), (20, 90), (40, 75), (60, 55), (80, 30), (100, 5))
NEXT_EARNINGS = ((0, 10), (3, 10), (7, 30), (14, 55), (21, 70), (45, 90), (46, 100))
LAST_EARNINGS = ((0, 35), (1, 35), (5, 60), (15, 85), (45, 95))
MOMENTUM_WEIGHTS, MA_WEIGHTS, SELLOFF_WEIGHTS = (65, 35), (60, 40), (45, 30, 25)
LONG_WEIGHTS = {"upside": 35, "sentiment": 30, "eps_revisions": 20, "target_agreement": 10, "long_trend": 5}
SHORT_WEIGHTS = {"momentum": 25, "ma_alignment": 25, "pullback_quality": 20, "selloff_stability": 15, "volatility": 10, "earnings_timing": 5}
LONG_CATEGORIES = ((45, "WEAK"), (60, "NEUTRAL"), (75, "POSITIVE"), (None, "STRONG"))
SHORT_CATEGORIES = ((40, "WAIT / AVOID"), (60, "NEUTRAL"), (75, "WATCH"), (None, "FAVORABLE ENTRY"))
PROFILE_TEXTS = {
    "INSUFFICIENT DATA": "Neither score has enough reliable data.",
    "TECHNICAL ONLY": "Entry score is available, but analyst-based score is insufficient.",
    "ANALYST VIEW ONLY": "Analyst-based score is available, but entry timing data is insufficient.",
    "STRONG CANDIDATE": "Strong analyst-based attractiveness and favorable entry timing.",
    "ATTRACTIVE BUT TECHNICALLY WEAK": "Strong analyst-based attractiveness, but the current technical setup is severely weak.",
    "ATTRACTIVE, WAIT FOR ENTRY": "Strong analyst-based attractiveness, but short-term timing is not yet favorable.",
    "TACTICAL CANDIDATE": "Good analyst-based score with especially favorable entry timing.",
    "MOMENTUM ONLY": "Entry timing is strong, but analyst-based support is weaker.",
    "RESEARCH CANDIDATE": "Both scores clear the research threshold.",
    "LOW PRIORITY": "Both scores do not clear the research thresholds.",
}
PRIORITIES = {"STRONG CANDIDATE": 1, "TACTICAL CANDIDATE": 2, "RESEARCH CANDIDATE": 3}
DRIVERS = (
    ("lt_score_upside", "analyst upside"),
    ("lt_score_sentiment", "analyst sentiment"),
    ("lt_score_eps_revisions", "EPS revisions"),
    ("lt_score_target_agreement", "target agreement"),
    ("lt_score_long_trend", "long-term trend"),
    ("st_score_momentum", "momentum quality"),
    ("st_score_ma_alignment", "moving-average alignment"),
    ("st_score_pullback_quality", "pullback quality"),
    ("st_score_selloff_stability", "selloff stability"),
    ("st_score_volatility", "volatility profile"),
    ("st_score_earnings_timing", "earnings timing"),
)
FLAG_TEXTS = (
    ("HIGH_TARGET_DISAGREEMENT", "High target disagreement"),
    ("EXTREME_TARGET_UPSIDE", "Extreme target upside may be stale or uncertain"),
    ("NEGATIVE_EPS_REVISIONS", "Negative EPS revisions"),
    ("EARNINGS_WITHIN_3_DAYS", "Earnings within 3 days"),
    ("EARNINGS_WITHIN_7_DAYS", "Earnings within 7 days"),
    ("POST_EARNINGS_PRICE_DISCOVERY", "Post-earnings price discovery"),
    ("SHARP_RECENT_SELLOFF", "Sharp recent selloff"),
    ("SHORT_TERM_OVEREXTENDED", "Short-term overextension"),
    ("EXTREME_OVEREXTENSION", "Extreme overextension"),
    ("LOW_LIQUIDITY", "Low liquidity warning"),
    ("VERY_LOW_LIQUIDITY", "Very low liquidity"),
    ("HIGH_VOLATILITY", "High volatility"),
)
NO_POSITIVE, NO_NEGATIVE = "No standout positive drivers", "No standout negative drivers"


def sentiment(strong_buy: Column, buy: Column, hold: Column, sell: Column, strong_sell: Column) -> dict[str, Column]:
    """score, positive, negative, hold shares and strength; all NULL without ratings."""
    sb, b, h, s, ss = (F.coalesce(F.greatest(c, F.lit(0.0)), F.lit(0.0)) for c in (strong_buy, buy, hold, sell, strong_sell))
    t = sb + b + h + s + ss
    t = F.when(t > 0, t)
    positive, strength = (sb + b) / t * 100, (100 * sb + 80 * b + 50 * h + 20 * s) / t
    return {"score": clip(0.70 * positive + 0.30 * strength), "positive": positive, "negative": (s + ss) / t * 100, "hold": h / t * 100, "strength": strength}


def eps_revisions(up: Column, down: Column) -> tuple[Column, Column]:
    """(score, whether there is data)."""
    have = up.isNotNull() | down.isNotNull()
    u, d = (F.coalesce(F.greatest(c, F.lit(0.0)), F.lit(0.0)) for c in (up, down))
    score = F.when(u + d == 0, F.lit(50.0)).otherwise(clip(((u - d) / F.greatest(u + d, F.lit(1.0)) + 1) / 2 * 100))
    return F.when(have, score), have


def coverage_confidence(rating_count: Column) -> Column:
    return piecewise(rating_count, COVERAGE) / 100


def coverage_multiplier(confidence: Column) -> Column:
    return clip(0.70 + 0.30 * confidence, 0, 1)


def momentum(r5: Column, r20: Column) -> Column:
    return weighted(zip((piecewise(r5, MOMENTUM_5D), piecewise(r20, MOMENTUM_20D)), MOMENTUM_WEIGHTS, strict=True))[0]


def ma_alignment(d20: Column, d50: Column) -> Column:
    return weighted(zip((piecewise(d20, MA_DISTANCE), piecewise(d50, MA_DISTANCE)), MA_WEIGHTS, strict=True))[0]


def selloff_stability(r2: Column, red_days: Column, worst: Column) -> tuple[Column, Column, Column]:
    """(score, coverage in per cent, status)."""
    score, coverage = weighted(zip((piecewise(r2, SELLOFF_2D), piecewise(red_days, RED_DAYS), piecewise(worst, WORST_DAY)), SELLOFF_WEIGHTS, strict=True))
    return score, coverage, F.when(coverage == 0, INSUFFICIENT).when(coverage < 100, PARTIAL).otherwise(RANKED)


def earnings_timing(to_next: Column, since_last: Column) -> Column:
    return F.when(to_next >= 0, piecewise(to_next, NEXT_EARNINGS)).when(since_last >= 0, piecewise(since_last, LAST_EARNINGS))


def category(score: Column, steps: tuple[tuple[float | None, str], ...]) -> Column:
    out = F.when(score.isNull(), "INSUFFICIENT DATA")
    for below, name in steps:
        out = out.otherwise(name) if below is None else out.when(score < below, name)
    return out


def candidate_profile(lt: Column, st: Column) -> Column:
    """The first rule that holds."""
    return (
        F.when(lt.isNull() & st.isNull(), "INSUFFICIENT DATA")
        .when(lt.isNull(), "TECHNICAL ONLY")
        .when(st.isNull(), "ANALYST VIEW ONLY")
        .when((lt >= 75) & (st >= 75), "STRONG CANDIDATE")
        .when((lt >= 75) & (st < 40), "ATTRACTIVE BUT TECHNICALLY WEAK")
        .when((lt >= 75) & (st < 60), "ATTRACTIVE, WAIT FOR ENTRY")
        .when((lt >= 60) & (st >= 75), "TACTICAL CANDIDATE")
        .when((lt < 60) & (st >= 75), "MOMENTUM ONLY")
        .when((lt >= 60) & (st >= 60), "RESEARCH CANDIDATE")
        .otherwise("LOW PRIORITY")
    )


def lookup(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def driver_texts(flags: Column) -> tuple[Column, Column]:
    """(positive, negative) drivers from the score columns of DRIVERS and the |-joined flags."""
    raised = F.split(F.coalesce(flags, F.lit("")), r"[|]")
    good = [F.when(F.col(c) >= 75, F.lit(f"Strong {label}")) for c, label in DRIVERS]
    bad = [F.when(F.col(c) <= 35, F.lit(f"Weak {label}")) for c, label in DRIVERS] + [F.when(F.array_contains(raised, flag), F.lit(text)) for flag, text in FLAG_TEXTS]
    joined = lambda parts, none: F.coalesce(F.nullif(F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), "; "), F.lit("")), F.lit(none))
    return joined(good, NO_POSITIVE), joined(bad, NO_NEGATIVE)


def risk_penalty_long(adv: Column, volatility: Column, upside: Column, dispersion: Column) -> Column:
    add = lambda cond, k: F.when(cond, F.lit(k)).otherwise(F.lit(0.0))
    liquidity = F.when(adv < 5_000_000, 5.0).when(adv < 10_000_000, 3.0).when(adv < 20_000_000, 1.0).otherwise(0.0)
    return liquidity + add(volatility > 60, 1.0) + add(upside >= 80, 2.0) + add(dispersion > 50, 2.0)


def risk_penalty_short(adv: Column, r5: Column, r20: Column) -> Column:
    add = lambda cond, k: F.when(cond, F.lit(k)).otherwise(F.lit(0.0))
    return add(adv < 5_000_000, 10.0) + add(r5 <= -10, 3.0) + add(r20 >= 40, 3.0)
