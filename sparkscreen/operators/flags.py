"""Risk flags: names of the conditions that hold, joined by | in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScreenConfig


def conditions(config: ScreenConfig) -> list[tuple[str, Column]]:
    """A NULL operand raises no flag."""
    c = F.col
    missing_price, missing_target = c("current_price").isNull(), c("selected_target_price").isNull()
    partial = missing_price | missing_target | (c("rating_count") < 5)
    broken = (F.trim(F.coalesce("history_error", F.lit("nan"))) != "") | (F.trim(F.coalesce("data_errors", F.lit("nan"))) != "")
    return [
        ("MISSING_CURRENT_PRICE", missing_price),
        ("MISSING_ANALYST_TARGET", missing_target),
        ("MISSING_RECOMMENDATIONS", c("rating_count") == 0),
        ("LOW_ANALYST_COVERAGE", c("rating_count") < config.low_coverage_ratings),
        ("HIGH_TARGET_DISAGREEMENT", c("target_dispersion_pct") > config.high_dispersion_pct),
        ("EXTREME_TARGET_UPSIDE", c("selected_target_upside_pct") >= 80),
        ("EARNINGS_WITHIN_3_DAYS", c("days_to_next_earnings").between(0, 3)),
        ("EARNINGS_WITHIN_7_DAYS", c("days_to_next_earnings").between(0, config.earnings_warning_days)),
        ("POST_EARNINGS_PRICE_DISCOVERY", c("days_since_last_earnings").between(0, 5)),
        ("NEGATIVE_EPS_REVISIONS", c("eps_down_30d") > c("eps_up_30d")),
        ("BELOW_200D_MA", c("current_price") < c("ma_200")),
        ("HIGH_VOLATILITY", c("volatility_annual_pct") > config.high_volatility_pct),
        ("VERY_LOW_LIQUIDITY", c("average_dollar_volume_20d") < config.very_low_dollar_volume),
        ("LOW_LIQUIDITY", c("average_dollar_volume_20d") < config.low_dollar_volume),
        ("SHARP_RECENT_SELLOFF", c("return_5d_pct") <= -10),
        ("SHORT_TERM_OVEREXTENDED", c("return_5d_pct") >= 15),
        ("EXTREME_OVEREXTENSION", c("return_20d_pct") >= 40),
        ("PARTIAL_DATA", partial),
        ("OPTIONAL_DATA_MISSING", ~partial & broken),
    ]


def risk_flags(config: ScreenConfig) -> Column:
    return F.concat_ws("|", *(F.when(cond, F.lit(name)) for name, cond in conditions(config)))
