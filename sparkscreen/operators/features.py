"""Analyst and price features of each company, from constituents, price metrics and analyst data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreenConfig
from ..functions import scores
from ..functions.exprs import finite, pct_over
from ..functions.parse import instant, utc
from .flags import risk_flags
from .joins import left_join_one_to_one
from .stages import staged

RATINGS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
NUMBERS = ("latest_quote", "target_current", "target_low", "target_mean", "target_median", "target_high", *RATINGS, "eps_up_7d", "eps_down_7d", "eps_up_30d", "eps_down_30d")


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86400e6)


def build_analysis(constituents: DataFrame, prices: DataFrame, analysts: DataFrame, config: ScreenConfig, check: bool = True) -> DataFrame:
    df = left_join_one_to_one(left_join_one_to_one(constituents, prices, check=check), analysts, check=check)
    df = df.withColumns({c: finite(F.col(c)) for c in NUMBERS if c in df.columns})
    c = F.col
    df = staged(df).withColumns({"current_price": F.coalesce("latest_quote", "history_price"), "selected_target_price": F.coalesce("target_median", "target_mean")})
    df = staged(df)
    total = sum((F.coalesce(c(r), F.lit(0.0)) for r in RATINGS[1:]), F.coalesce(c(RATINGS[0]), F.lit(0.0)))
    feel = scores.sentiment(*(c(r) for r in RATINGS))
    due = utc(c("next_earnings_date")) if dict(df.dtypes)["next_earnings_date"] == "timestamp" else c("next_earnings_date").cast("timestamp_ntz")
    to_next = days_between(due, instant(F.lit(config.run_ts)))
    df = df.withColumns(
        {
            "current_price_source": F.when(c("latest_quote").isNotNull(), "FRESH_FAST_INFO").when(c("history_price").isNotNull(), "FRESH_DAILY_CLOSE_FALLBACK").otherwise("MISSING"),
            "selected_target": c("selected_target_price"),
            "selected_target_source": F.when(c("target_median").isNotNull(), "MEDIAN").when(c("target_mean").isNotNull(), "MEAN_FALLBACK").otherwise("MISSING"),
            "selected_target_upside_pct": F.when(c("current_price") > 0, pct_over(c("selected_target_price"), c("current_price"))),
            "rating_count": total,
            "positive_rating_pct": feel["positive"],
            "negative_rating_pct": feel["negative"],
            "hold_rating_pct": feel["hold"],
            "lt_score_sentiment": feel["score"],
            "recommendation_strength_score": feel["strength"],
            "mean_vs_median_pct": pct_over(c("target_mean"), c("target_median")),
            "target_dispersion_pct": F.try_divide(c("target_high") - c("target_low"), c("selected_target_price")) * 100,
            "days_to_earnings": to_next,
        }
    )
    df = staged(df)
    points = sum((w * F.coalesce(c(r), F.lit(0.0)) for r, w in zip(RATINGS[1:], (1, 0, -1, -2), strict=True)), 2 * F.coalesce(c(RATINGS[0]), F.lit(0.0)))
    df = df.withColumns(
        {
            "selected_target_type": c("selected_target_source"),
            "recommendation_score_simple": points / F.when(c("rating_count") != 0, 2 * c("rating_count")),
            "days_to_next_earnings": c("days_to_earnings"),
            "days_since_last_earnings": F.when(c("days_to_earnings") < 0, F.abs("days_to_earnings")),
        }
    )
    return staged(df)


def first_flags(analysis: DataFrame, config: ScreenConfig) -> DataFrame:
    """risk_flags before short-term returns are known, and has_partial_data from them."""
    none = {k: F.lit(None).cast("double") for k in ("return_5d_pct", "return_20d_pct") if k not in analysis.columns}
    df = analysis.withColumns(none).withColumn("risk_flags", risk_flags(config))
    return df.withColumn("has_partial_data", F.coalesce(F.contains("risk_flags", F.lit("PARTIAL_DATA")), F.lit(False))).drop(*none)
