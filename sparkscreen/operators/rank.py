"""Rankings and segments of the scored companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INSUFFICIENT
from .composite import RANKABLE
from .ordering import numbered

# Sort keys, all descending with NULLs last but the first of COMBINED_KEYS; input order breaks ties.
LONG_KEYS = ("analyst_long_term_score", "short_term_entry_score", "positive_rating_pct", "rating_count")
SHORT_KEYS = ("short_term_entry_score", "analyst_long_term_score", "positive_rating_pct")
COMBINED_KEYS = ("candidate_profile_priority", "combined_score", "short_term_entry_score", "analyst_long_term_score")
# Columns of the printed tables.
LONG_COLUMNS = (
    "long_term_rank", "short_term_rank", "symbol", "company_name", "analyst_long_term_raw_score", "analyst_long_term_score", "analyst_long_term_category",
    "analyst_long_term_status", "analyst_coverage_confidence", "analyst_coverage_multiplier", "analyst_long_term_data_coverage_pct", "short_term_entry_score",
    "short_term_category", "current_price", "selected_target_upside_pct", "positive_rating_pct", "rating_count", "target_dispersion_pct", "return_5d_pct", "risk_flags",
)
SHORT_COLUMNS = (
    "short_term_rank", "long_term_rank", "symbol", "company_name", "short_term_entry_score", "short_term_category", "analyst_long_term_score",
    "analyst_long_term_category", "current_price", "return_1d_pct", "return_2d_pct", "return_5d_pct", "return_20d_pct", "drawdown_from_20d_high_pct",
    "short_volatility_20d_pct", "selloff_stability_data_coverage_pct", "selloff_stability_status", "risk_flags",
)
COMBINED_COLUMNS = (
    "combined_rank", "symbol", "company_name", "combined_score", "analyst_long_term_score", "short_term_entry_score", "candidate_profile",
    "candidate_profile_priority", "current_price", "selected_target_upside_pct", "positive_rating_pct", "rating_count", "return_2d_pct", "return_5d_pct", "risk_flags",
)


def long_order() -> list:
    return [F.col(k).desc_nulls_last() for k in LONG_KEYS] + [F.col("ordinal").asc()]


def short_order() -> list:
    return [F.col(k).desc_nulls_last() for k in SHORT_KEYS] + [F.col("ordinal").asc()]


def combined_order() -> list:
    return [F.col(COMBINED_KEYS[0]).asc()] + [F.col(k).desc_nulls_last() for k in COMBINED_KEYS[1:]] + [F.col("ordinal").asc()]


def long_term_ranking(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("analyst_long_term_status").isin(*RANKABLE)).orderBy(*long_order())


def short_term_ranking(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("short_term_status").isin(*RANKABLE)).orderBy(*short_order())


def combined_filter() -> Column:
    c = F.col
    return (
        (c("analyst_long_term_score") >= 60)
        & (c("short_term_entry_score") >= 60)
        & c("analyst_long_term_status").isin(*RANKABLE)
        & c("short_term_status").isin(*RANKABLE)
        & (c("analyst_long_term_data_coverage_pct") >= 80)
        & (c("short_term_data_coverage_pct") >= 80)
        & (c("overall_data_quality") != "INSUFFICIENT")
    )


def combined_candidates(scored: DataFrame) -> DataFrame:
    ranked = numbered(scored.where(combined_filter()), combined_order(), "combined_rank")
    return ranked.withColumn("combined_rank", F.col("combined_rank").cast("int")).orderBy("combined_rank")


def rankings(scored: DataFrame) -> dict[str, DataFrame]:
    """The eight tables of a run."""
    combined = combined_candidates(scored)
    profile = F.col("candidate_profile")
    return {
        "long_term_ranking": long_term_ranking(scored),
        "short_term_ranking": short_term_ranking(scored),
        "combined_candidates": combined,
        "strong_candidates": combined.where(profile == "STRONG CANDIDATE"),
        "wait_for_entry": scored.where(profile == "ATTRACTIVE, WAIT FOR ENTRY"),
        "tactical_candidates": combined.where(profile == "TACTICAL CANDIDATE"),
        "momentum_only": scored.where(profile == "MOMENTUM ONLY"),
        "insufficient_data": scored.where((F.col("analyst_long_term_status") == INSUFFICIENT) | (F.col("short_term_status") == INSUFFICIENT)),
    }


def segments(scored: DataFrame) -> DataFrame:
    """A row (segment, ...) for each segment that a company is in, in one pass over the companies."""
    chosen, profile = F.coalesce(combined_filter(), F.lit(False)), F.col("candidate_profile")
    found = {
        "strong_candidates": chosen & (profile == "STRONG CANDIDATE"),
        "wait_for_entry": profile == "ATTRACTIVE, WAIT FOR ENTRY",
        "tactical_candidates": chosen & (profile == "TACTICAL CANDIDATE"),
        "momentum_only": profile == "MOMENTUM ONLY",
        "insufficient_data": (F.col("analyst_long_term_status") == INSUFFICIENT) | (F.col("short_term_status") == INSUFFICIENT),
    }
    return scored.select(F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in found.items())))).alias("segment"), "*")


def top(table: DataFrame, columns: tuple[str, ...], n: int, order: list) -> DataFrame:
    """The printed table: the first n rows, existing columns only, numbers rounded to 2 places."""
    rounded = {"double", "float"}
    kinds = dict(table.dtypes)
    chosen = [F.bround(c, 2).alias(c) if kinds[c] in rounded else F.col(c) for c in columns if c in kinds]
    return table.orderBy(*order).limit(n).select(*chosen)
