"""The two composite scores with status, penalties, categories, profile and ranks.

Expressions are built in stages of columns, components before composites before texts, that staged() keeps apart, so that
no projection grows past what code generation takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INSUFFICIENT, PARTIAL, RANKED, ScreenConfig
from ..functions import scores
from ..functions.exprs import clip, piecewise, weighted
from .flags import risk_flags
from .joins import left_join_one_to_one
from .ordering import min_ranks, percentile_in_group
from .stages import staged
from .stored import stored

RANKABLE = (RANKED, PARTIAL)


def _status(critical: Column, coverage: str, least: float) -> Column:
    return F.when(critical | (F.col(coverage) < least), INSUFFICIENT).when(F.col(coverage) < 100, PARTIAL).otherwise(RANKED)


def sector_percentiles(constituents: DataFrame, metrics: DataFrame) -> DataFrame:
    """metrics, a row a symbol, with sector_volatility_percentile."""
    sectors = metrics.join(constituents.select("symbol", "sector"), "symbol", "left")
    return percentile_in_group(sectors, "short_volatility_20d_pct", "sector", "sector_volatility_percentile").drop("sector")


def component_scores(analysis: DataFrame, short: DataFrame | None, config: ScreenConfig, check: bool = True) -> DataFrame:
    """short: the short-term metrics to join, None if analysis has their columns. sector_volatility_percentile is computed
    unless analysis has it: sector_percentiles() does that earlier, where fewer joins lie below."""
    c = F.col
    df = analysis if short is None else left_join_one_to_one(analysis, short, check=check)
    if "sector_volatility_percentile" not in df.columns:
        df = percentile_in_group(df, "short_volatility_20d_pct", "sector", "sector_volatility_percentile")
    eps, have_eps = scores.eps_revisions(c("eps_up_30d"), c("eps_down_30d"))
    selloff, selloff_coverage, selloff_status = scores.selloff_stability(c("return_2d_pct"), c("negative_days_last_5"), c("worst_daily_return_5d_pct"))
    by_sector = c("sector_volatility_percentile").isNotNull()
    return staged(df).withColumns(
        {
            "price_vs_ma20_pct": c("distance_from_ma20_pct"),
            "price_vs_ma50_pct": c("distance_from_ma50_pct"),
            "lt_score_upside": piecewise(c("selected_target_upside_pct"), scores.UPSIDE),
            "lt_score_eps_revisions": eps,
            "eps_revision_data_available": have_eps,
            "lt_score_target_agreement": piecewise(c("target_dispersion_pct"), scores.AGREEMENT),
            "lt_score_long_trend": piecewise(c("price_vs_200d_ma_pct"), scores.LONG_TREND),
            "analyst_coverage_confidence": scores.coverage_confidence(c("rating_count")),
            "st_score_momentum": scores.momentum(c("return_5d_pct"), c("return_20d_pct")),
            "st_score_ma_alignment": scores.ma_alignment(c("distance_from_ma20_pct"), c("distance_from_ma50_pct")),
            "st_score_pullback_quality": piecewise(c("drawdown_from_20d_high_pct"), scores.PULLBACK),
            "st_score_selloff_stability": selloff,
            "selloff_stability_data_coverage_pct": selloff_coverage,
            "selloff_stability_status": selloff_status,
            "st_score_volatility": F.when(by_sector, piecewise(c("sector_volatility_percentile"), scores.SECTOR_VOLATILITY)).otherwise(piecewise(c("short_volatility_20d_pct"), scores.VOLATILITY)),
            "volatility_scoring_method": F.when(by_sector, "SECTOR_RELATIVE").otherwise("ABSOLUTE_FALLBACK"),
            "st_score_earnings_timing": scores.earnings_timing(c("days_to_next_earnings"), c("days_since_last_earnings")),
        }
    )


def composite_scores(df: DataFrame, config: ScreenConfig) -> DataFrame:
    c = F.col
    long_raw, long_coverage = weighted((c(f"lt_score_{k}"), w) for k, w in scores.LONG_WEIGHTS.items())
    short_raw, short_coverage = weighted((c(f"st_score_{k}"), w) for k, w in scores.SHORT_WEIGHTS.items())
    df = staged(staged(df).withColumns({"__lt": long_raw, "analyst_long_term_data_coverage_pct": long_coverage, "__st": short_raw, "short_term_data_coverage_pct": short_coverage}))
    long_critical = c("current_price").isNull() | c("selected_target_price").isNull() | (c("rating_count") < 5)
    needs = ("current_price", "return_5d_pct", "return_20d_pct", "distance_from_ma20_pct", "distance_from_ma50_pct", "short_volatility_20d_pct", "drawdown_from_20d_high_pct")
    short_critical = F.lit(False)
    for k in needs:
        short_critical = short_critical | c(k).isNull()
    df = df.withColumns(
        {
            "analyst_long_term_status": _status(long_critical, "analyst_long_term_data_coverage_pct", config.min_long_coverage_pct),
            "short_term_status": _status(short_critical, "short_term_data_coverage_pct", config.min_short_coverage_pct),
            "analyst_coverage_multiplier": scores.coverage_multiplier(c("analyst_coverage_confidence")),
            "long_term_risk_penalty": scores.risk_penalty_long(c("average_dollar_volume_20d"), c("volatility_annual_pct"), c("selected_target_upside_pct"), c("target_dispersion_pct")),
            "short_term_risk_penalty": scores.risk_penalty_short(c("average_dollar_volume_20d"), c("return_5d_pct"), c("return_20d_pct")),
        }
    )
    df = staged(df)
    long_ok, short_ok = c("analyst_long_term_status") != INSUFFICIENT, c("short_term_status") != INSUFFICIENT
    df = df.withColumns({"analyst_long_term_raw_score": F.when(long_ok, c("__lt")), "short_term_raw_score": F.when(short_ok, c("__st"))}).drop("__lt", "__st")
    df = df.withColumns(
        {
            "analyst_long_term_score": clip(c("analyst_long_term_raw_score") * c("analyst_coverage_multiplier") - c("long_term_risk_penalty")),
            "short_term_entry_score": clip(c("short_term_raw_score") - c("short_term_risk_penalty")),
        }
    )
    df = staged(df)
    long, short = c("analyst_long_term_score"), c("short_term_entry_score")
    high = (c("analyst_long_term_status") == RANKED) & (c("short_term_status") == RANKED) & (c("analyst_long_term_data_coverage_pct") >= 90) & (c("short_term_data_coverage_pct") >= 90)
    df = df.withColumns(
        {
            "long_term_score": long,
            "analyst_long_term_category": scores.category(long, scores.LONG_CATEGORIES),
            "short_term_category": scores.category(short, scores.SHORT_CATEGORIES),
            "candidate_profile": scores.candidate_profile(long, short),
            "combined_score": 0.60 * long + 0.40 * short,
            "overall_data_quality": F.when(high, "HIGH").when(long_ok & short_ok, "MEDIUM").when(long_ok | short_ok, "LOW").otherwise("INSUFFICIENT"),
            "risk_flags": risk_flags(config),
        }
    )
    good, bad = scores.driver_texts(c("risk_flags"))
    df = staged(df).withColumns(
        {
            "long_term_category": c("analyst_long_term_category"),
            "candidate_profile_explanation": scores.lookup(c("candidate_profile"), scores.PROFILE_TEXTS, None),
            "candidate_profile_priority": scores.lookup(c("candidate_profile"), scores.PRIORITIES, 99),
            "has_partial_data": F.coalesce(F.contains("risk_flags", F.lit("PARTIAL_DATA")), F.lit(False)),
            "top_positive_drivers": good,
            "top_negative_drivers": bad,
        }
    )
    return staged(df)


def with_ranks(df: DataFrame) -> DataFrame:
    """Minimum ranks among the rankable, by both scores. df is stored: whatever asks for the companies then reads that."""
    df = stored(df)
    able = lambda status: F.col(status).isin(*RANKABLE)
    ranked = min_ranks(df, {"long_term_rank": ("analyst_long_term_score", able("analyst_long_term_status")), "short_term_rank": ("short_term_entry_score", able("short_term_status"))})
    return ranked.withColumns({c: F.col(c).cast("int") for c in ("long_term_rank", "short_term_rank")})
