"""Run metadata, methodology, validation and the detail view of one company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSUFFICIENT, MODEL_VERSION, PARTIAL, ScreenConfig
from .composite import RANKABLE
from .rank import combined_filter

SCORES = ("analyst_long_term_raw_score", "analyst_long_term_score", "short_term_raw_score", "short_term_entry_score", "combined_score")
DATA_SOURCES = "Constituent, price and analyst tables of the run."
# Topics and descriptions of the methodology table.
METHODOLOGY = (
    ("model_version", MODEL_VERSION),
    ("purpose", "Research screener; not a buy/sell recommendation."),
    ("analyst_long_term_score", "Analyst-based score: raw score uses target upside 35%, sentiment 30%, EPS revisions 20%, target agreement 10%, MA200 trend 5%; final score applies analyst_coverage_multiplier and modest risk penalties."),
    ("short_term_entry_score", "Technical entry score: momentum 25%, MA alignment 25%, pullback 20%, selloff stability 15%, volatility 10%, earnings timing 5%."),
    ("missing_data", "Critical missing data produces NaN and INSUFFICIENT_DATA; optional missing components are excluded with dynamic weight normalization."),
    ("confidence", "Analyst coverage confidence is softened through analyst_coverage_multiplier = 0.70 + 0.30 * analyst_coverage_confidence; fewer than 5 ratings is insufficient."),
    ("risk_penalties", "Long-term penalties: very low liquidity -5, low liquidity -3, liquidity warning -1, high volatility -1, extreme target upside -2, high target disagreement -2. Short-term penalties: very low liquidity -10, sharp recent selloff -3, extreme overextension -3."),
    ("selloff_stability", "Selloff stability uses return_2d_pct 45%, negative_days_last_5 30%, worst_daily_return_5d_pct 25%; missing subcomponents are excluded and subweights are dynamically normalized."),
    ("candidate_profiles", "ATTRACTIVE BUT TECHNICALLY WEAK means strong analyst-based attractiveness with severely weak technical setup; ATTRACTIVE, WAIT FOR ENTRY means strong analyst-based attractiveness but timing is not favorable yet."),
    ("categories", "Long term: WEAK <45, NEUTRAL <60, POSITIVE <75, STRONG >=75. Short term: WAIT/AVOID <40, NEUTRAL <60, WATCH <75, FAVORABLE ENTRY >=75."),
    ("limitations", "Scores can be affected by stale analyst targets, delayed revisions, market shocks, sector events, and incomplete source data."),
)
# Columns of the detail view.
DETAIL = (
    "symbol", "company_name", "sector", "long_term_rank", "analyst_long_term_raw_score", "analyst_long_term_score", "analyst_long_term_category",
    "analyst_long_term_status", "analyst_coverage_confidence", "analyst_coverage_multiplier", "analyst_long_term_data_coverage_pct", "short_term_rank",
    "short_term_raw_score", "short_term_entry_score", "short_term_category", "short_term_status", "short_term_data_coverage_pct", "combined_score",
    "candidate_profile", "candidate_profile_priority", "candidate_profile_explanation", "current_price", "current_price_source", "price_as_of", "target_low",
    "target_mean", "target_median", "target_high", "selected_target_price", "selected_target_source", "selected_target_upside_pct", "strong_buy", "buy", "hold",
    "sell", "strong_sell", "positive_rating_pct", "negative_rating_pct", "hold_rating_pct", "recommendation_strength_score", "rating_count",
    "target_dispersion_pct", "eps_up_7d", "eps_down_7d", "eps_up_30d", "eps_down_30d", "return_1d_pct", "return_2d_pct", "return_5d_pct", "return_20d_pct",
    "distance_from_ma20_pct", "distance_from_ma50_pct", "drawdown_from_20d_high_pct", "short_volatility_20d_pct", "negative_days_last_5", "next_earnings_date",
    "days_to_earnings", "days_to_next_earnings", "days_since_last_earnings", "lt_score_upside", "lt_score_sentiment", "lt_score_target_agreement",
    "lt_score_eps_revisions", "lt_score_long_trend", "long_term_risk_penalty", "short_term_risk_penalty", "st_score_momentum", "st_score_ma_alignment",
    "st_score_selloff_stability", "selloff_stability_data_coverage_pct", "selloff_stability_status", "st_score_pullback_quality", "st_score_volatility",
    "st_score_earnings_timing", "risk_flags", "top_positive_drivers", "top_negative_drivers", "data_errors", "data_fetched_at_utc",
)


def methodology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODOLOGY), "topic string, description string")


#: The column that tells whether a company has what a topic is about; for other topics every company counts.
TOPIC_COLUMNS = {
    "analyst_long_term_score": "analyst_long_term_score",
    "short_term_entry_score": "short_term_entry_score",
    "confidence": "analyst_coverage_confidence",
    "risk_penalties": "long_term_risk_penalty",
    "selloff_stability": "st_score_selloff_stability",
    "candidate_profiles": "candidate_profile",
    "categories": "analyst_long_term_category",
}


def methodology_coverage(scored: DataFrame) -> DataFrame:
    """The methodology with the number of companies that have what each topic is about."""
    topics = [t for t, _ in METHODOLOGY]
    counts = scored.agg(*(F.count(TOPIC_COLUMNS.get(t, "symbol")).alias(t) for t in topics)).unpivot([], topics, "topic", "companies")
    return methodology(scored.sparkSession).join(counts, "topic")


def display(c: Column, suffix: str = "") -> Column:
    """A number with thousands separators and 2 places; N/A where it is missing."""
    return F.coalesce(F.concat(F.format_number(c, 2), F.lit(suffix)), F.lit("N/A"))


def field_values(row: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (field, value) of a single row, values as strings."""
    return row.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value")


def run_metadata(constituents: DataFrame, analysts: DataFrame, scored: DataFrame, config: ScreenConfig) -> DataFrame:
    """Rows (field, value). scored has a row a constituent with its history_price, so prices are not looked at again."""
    able = lambda c: F.col(c).isin(*RANKABLE)
    partial = (F.col("analyst_long_term_status") == PARTIAL) | (F.col("short_term_status") == PARTIAL)
    counts = scored.agg(
        F.count("history_price").alias("successful_price_rows"),
        F.count_if(able("short_term_status")).alias("complete_price_history_symbols"),
        F.count_if(able("analyst_long_term_status")).alias("ranked_long_term"),
        F.count_if(able("short_term_status")).alias("ranked_short_term"),
        F.count_if(partial).alias("partial_data_rows"),
        F.count_if(F.col("overall_data_quality") == "INSUFFICIENT").alias("insufficient_data_rows"),
    )
    fixed = {"run_timestamp_utc": config.run_ts, "scoring_model_version": MODEL_VERSION, "data_sources": DATA_SOURCES, "script_version": MODEL_VERSION}
    constants = [F.lit(v).alias(k) for k, v in fixed.items()]
    rows = [
        constituents.agg(F.count("*").alias("sp500_constituents"), *(F.max(c).alias(k) for k, c in zip(fixed, constants, strict=True))),
        analysts.agg(F.count("*").alias("analyst_data_rows")),
        counts,
    ]
    # each part is one row, so its fields are unpivoted by themselves and put together
    parts = [field_values(r, r.columns) for r in rows]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def validation_counts(scored: DataFrame) -> DataFrame:
    """Rows (invariant, broken): how many rows break each invariant."""
    outside = {f"outside_{c}": F.count_if(~F.col(c).between(0, 100)) for c in SCORES}
    low = (F.col("analyst_long_term_score") < 60) | (F.col("short_term_entry_score") < 60)
    row = scored.agg(
        *(v.alias(k) for k, v in outside.items()),
        F.count_if((F.col("analyst_long_term_status") == INSUFFICIENT) & F.col("analyst_long_term_score").isNotNull()).alias("scored_insufficient_long"),
        F.count_if((F.col("short_term_status") == INSUFFICIENT) & F.col("short_term_entry_score").isNotNull()).alias("scored_insufficient_short"),
        F.count_if(combined_filter() & low).alias("low_combined"),
    )
    return row.unpivot([], row.columns, "invariant", "broken")


def validate(scored: DataFrame) -> None:
    broken = {r["invariant"]: r["broken"] for r in validation_counts(scored).where("broken > 0").collect()}
    if broken:
        raise AssertionError(f"invariants are broken: {broken}")


def ticker_display(scored: DataFrame, ticker: str) -> DataFrame:
    """ticker_detail with values as they are shown: numbers with separators and 2 places, shares with %, N/A where one is missing;
    ranks as ``rank/companies``."""
    symbol = ticker.strip().upper().replace(".", "-")
    kinds = dict(scored.dtypes)
    row = scored.where(F.col("symbol") == symbol).limit(1).crossJoin(F.broadcast(scored.agg(F.count(F.lit(1)).alias("__companies"))))  # one row and one row

    def shown(c: str) -> Column:
        if c.endswith("_rank"):
            return F.concat_ws("/", F.coalesce(F.col(c).cast("string"), F.lit("N/A")), F.col("__companies"))
        if kinds[c] in ("double", "float"):
            return display(F.col(c), "%" if c.endswith("_pct") else "")
        text = F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
        return F.when(text == "", "None").otherwise(text) if c == "risk_flags" else text

    columns = [c for c in DETAIL if c in kinds]
    return row.select(*(shown(c).alias(c) for c in columns)).unpivot([], columns, "field", "value")


def ticker_detail(scored: DataFrame, ticker: str) -> DataFrame:
    """Rows (field, value) of one company; none if it isn't there. Filter a stored table: ranks need all companies."""
    symbol = ticker.strip().upper().replace(".", "-")
    return field_values(scored.where(F.col("symbol") == symbol).limit(1), [c for c in DETAIL if c in scored.columns])
