"""The registered queries of the screen, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs, legacy, parse, scores
from ..operators import analysts, features, joins, ordering, rank, report, series
from ..operators.stored import stored
from ..sources import readers, testdata
from . import oracles as o
from . import screen

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = screen.ScreenConfig(run_ts=testdata.RUN_TS)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


# ---- relations of the screen -------------------------------------------------------------------------------------
PRICE_COLUMNS = dict.fromkeys(("history_price", "ma_20", "ma_50", "ma_200", "price_vs_200d_ma_pct", "volatility_annual_pct", "average_volume_20d", "average_dollar_volume_20d"), "double") | {"symbol": "s", "price_as_of": "t", "history_error": "s"}
SHORT_COLUMNS = {"symbol": "s"} | dict.fromkeys(
    ("short_price", "return_1d_pct", "return_2d_pct", "return_5d_pct", "return_20d_pct", "short_ma_20", "short_ma_50", "distance_from_ma20_pct", "distance_from_ma50_pct", "drawdown_from_20d_high_pct",
     "short_volatility_20d_pct", "volatility_20d_annualized_pct", "negative_days_last_5", "worst_daily_return_5d_pct"), "double")
FEATURE_COLUMNS = dict.fromkeys(
    ("current_price", "selected_target_price", "selected_target", "selected_target_upside_pct", "rating_count", "positive_rating_pct", "negative_rating_pct", "hold_rating_pct", "lt_score_sentiment", "recommendation_strength_score",
     "recommendation_score_simple", "mean_vs_median_pct", "target_dispersion_pct", "days_to_earnings", "days_to_next_earnings", "days_since_last_earnings"), "double") | dict.fromkeys(
    ("symbol", "current_price_source", "selected_target_source", "selected_target_type"), "s")
LONG_COLUMNS = {"symbol": "s", "analyst_long_term_status": "s", "analyst_long_term_category": "s", "long_term_category": "s", "eps_revision_data_available": "b", "long_term_rank": "i"} | dict.fromkeys(
    ("lt_score_upside", "lt_score_sentiment", "lt_score_eps_revisions", "lt_score_target_agreement", "lt_score_long_trend", "analyst_long_term_data_coverage_pct", "analyst_coverage_confidence", "analyst_coverage_multiplier",
     "analyst_long_term_raw_score", "long_term_risk_penalty", "analyst_long_term_score", "long_term_score"), "double")
SHORT_SCORE_COLUMNS = {"symbol": "s", "short_term_status": "s", "short_term_category": "s", "selloff_stability_status": "s", "volatility_scoring_method": "s", "short_term_rank": "i"} | dict.fromkeys(
    ("st_score_momentum", "st_score_ma_alignment", "st_score_pullback_quality", "st_score_selloff_stability", "selloff_stability_data_coverage_pct", "st_score_volatility", "sector_volatility_percentile", "st_score_earnings_timing",
     "price_vs_ma20_pct", "price_vs_ma50_pct", "short_term_data_coverage_pct", "short_term_raw_score", "short_term_risk_penalty", "short_term_entry_score"), "double")
DETAIL_COLUMNS = ["symbol", "company_name", "sector", "candidate_profile", "candidate_profile_explanation", "current_price_source", "selected_target_source", "analyst_long_term_status", "short_term_status", "risk_flags", "top_positive_drivers", "top_negative_drivers", "data_errors"]


def picked(get: Callable[[screen.Screen], DataFrame], columns: dict[str, str]) -> Query:
    return lambda spark, d: rounded(get(screen.from_testdata(spark, d)).select(*columns))


register("price_metrics", picked(lambda x: x.prices, PRICE_COLUMNS), f"with {o.CON}, {o.BARS}, {o.NUMBERED}, {o.PRICES} select {o.rounded(PRICE_COLUMNS)} from prices")
register("short_term_metrics", picked(lambda x: x.short, SHORT_COLUMNS), f"with {o.BARS}, {o.NUMBERED}, {o.SHORT} select {o.rounded(SHORT_COLUMNS)} from short")
register("analysis_features", picked(lambda x: x.analysis, FEATURE_COLUMNS), f"{o.UP_TO_ANALYSIS} select {o.rounded(FEATURE_COLUMNS)} from analysis")
register("long_term_score", picked(lambda x: x.scored, LONG_COLUMNS), f"{o.UP_TO_SCORED} select {o.rounded(LONG_COLUMNS)} from scored")
register("short_term_score", picked(lambda x: x.scored, SHORT_SCORE_COLUMNS), f"{o.UP_TO_SCORED} select {o.rounded(SHORT_SCORE_COLUMNS)} from scored")
PROFILE_COLUMNS = {"symbol": "s", "candidate_profile": "s", "candidate_profile_explanation": "s", "candidate_profile_priority": "i", "combined_score": "double", "overall_data_quality": "s"}
register("combined_profile", picked(lambda x: x.scored, PROFILE_COLUMNS), f"{o.UP_TO_SCORED} select {o.rounded(PROFILE_COLUMNS)} from scored")
TEXT_COLUMNS = {"symbol": "s", "risk_flags": "s", "has_partial_data": "b", "top_positive_drivers": "s", "top_negative_drivers": "s"}
register("risk_flags_and_drivers", picked(lambda x: x.scored, TEXT_COLUMNS), f"{o.UP_TO_SCORED} select {o.rounded(TEXT_COLUMNS)} from scored")
ALL_COLUMNS = {"sector": "s", "company_name": "s"} | PRICE_COLUMNS | SHORT_COLUMNS | FEATURE_COLUMNS | LONG_COLUMNS | SHORT_SCORE_COLUMNS | PROFILE_COLUMNS | TEXT_COLUMNS
register("dual_scores", picked(lambda x: x.scored, ALL_COLUMNS), f"{o.UP_TO_SCORED} select {o.rounded(ALL_COLUMNS)} from scored")
register(
    "first_pass_flags",
    lambda spark, d: features.first_flags(screen.from_testdata(spark, d).analysis, CONFIG).select("symbol", "risk_flags", "has_partial_data"),
    f"{o.UP_TO_ANALYSIS} select symbol, risk_flags, risk_flags like '%PARTIAL_DATA%' as has_partial_data from (select *, {o.FLAG_SQL} as risk_flags from (select *, null::double as return_5d_pct, null::double as return_20d_pct from analysis))",
)
register(
    "sector_vol_percentile",
    lambda spark, d: rounded(ordering.percentile_in_group(stored(joins.left_join_one_to_one(testdata.constituents(spark, d), series.short_term_metrics(testdata.bars(spark, d)), check=False)), "short_volatility_20d_pct", "sector", "percentile").select("symbol", "sector", "short_volatility_20d_pct", "percentile")),
    f"with {o.CON}, {o.BARS}, {o.NUMBERED}, {o.SHORT}, analysis as (select symbol, sector from constituents), {o.PERCENTILE} select symbol, sector, round(short_volatility_20d_pct, 6) as short_volatility_20d_pct, round(sector_volatility_percentile, 6) as percentile from ranked_vol",
)
register(
    "left_join_enrich",
    lambda spark, d: joins.left_join_one_to_one(testdata.constituents(spark, d), testdata.analysts(spark, d).select("symbol", "data_errors"), check=False).select("ordinal", "symbol", "company_name", "sector", "sub_industry", "data_errors"),
    f"with {o.CON}, {o.ANA} select ordinal, c.symbol, company_name, sector, sub_industry, data_errors from constituents c left join analysts a on c.symbol = a.symbol",
)
register(
    "key_uniqueness",
    lambda spark, d: joins.duplicates(testdata.bars(spark, d)),
    f"with {o.BARS} select symbol, count(*) as rows from bars group by symbol having count(*) > 1",
)
register(
    "constituents_dedup",
    lambda spark, d: readers.constituents(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey as ordinal", "concat(' BRK.', s_suppkey % 50, ' ') as Symbol", "s_name as Security", "cast(s_nationkey as string) as `GICS Sector`")).select("ordinal", "symbol", "source_symbol", "company_name", "sector"),
    "select ordinal, replace(trim(source_symbol), '.', '-') as symbol, source_symbol, company_name, sector from (select s_suppkey as ordinal, concat(' BRK.', s_suppkey % 50, ' ') as source_symbol, s_name as company_name, s_nationkey::varchar as sector, row_number() over (partition by s_suppkey % 50 order by s_suppkey) as rn from supplier) where rn = 1",
)

# ---- rankings ----------------------------------------------------------------------------------------------------
DOUBLES = {k for k, v in (PRICE_COLUMNS | SHORT_COLUMNS | FEATURE_COLUMNS | LONG_COLUMNS | SHORT_SCORE_COLUMNS | PROFILE_COLUMNS).items() if v == "double"}


def ranking(table: Callable[[DataFrame], DataFrame], columns, order) -> Query:
    return lambda spark, d: rank.top(table(screen.from_testdata(spark, d).scored), columns, 100, order())


def ranking_sql(table: str, columns, keys: str) -> str:
    chosen = ", ".join(f"round_even({c}, 2) as {c}" if c in DOUBLES else c for c in columns)
    return f"select {chosen} from (select * from {table} order by {keys} limit 100)"


register("long_rank", ranking(rank.long_term_ranking, rank.LONG_COLUMNS, rank.long_order), f"{o.UP_TO_SCORED} {ranking_sql(f'(select * from scored where analyst_long_term_status {o.ABLE})', rank.LONG_COLUMNS, o.order(rank.LONG_KEYS))}")
register("short_rank", ranking(rank.short_term_ranking, rank.SHORT_COLUMNS, rank.short_order), f"{o.UP_TO_SCORED} {ranking_sql(f'(select * from scored where short_term_status {o.ABLE})', rank.SHORT_COLUMNS, o.order(rank.SHORT_KEYS))}")
register("combined_candidates", ranking(rank.combined_candidates, rank.COMBINED_COLUMNS, rank.combined_order), f"{o.UP_TO_SCORED}, {o.COMBINED} {ranking_sql('combined', rank.COMBINED_COLUMNS, 'combined_rank')}")


def segments(spark: SparkSession, d: str) -> DataFrame:
    return rank.segments(screen.from_testdata(spark, d).scored).select("segment", "symbol", "candidate_profile", F.round("combined_score", 6).alias("combined_score"))


register(
    "segments",
    segments,
    f"{o.UP_TO_SCORED}, {o.COMBINED} "
    + " union all ".join(
        f"select '{n}' as segment, symbol, candidate_profile, round(combined_score, 6) as combined_score from {x}"
        for n, x in (
            ("strong_candidates", "combined where candidate_profile = 'STRONG CANDIDATE'"),
            ("wait_for_entry", "scored where candidate_profile = 'ATTRACTIVE, WAIT FOR ENTRY'"),
            ("tactical_candidates", "combined where candidate_profile = 'TACTICAL CANDIDATE'"),
            ("momentum_only", "scored where candidate_profile = 'MOMENTUM ONLY'"),
            ("insufficient_data", "scored where analyst_long_term_status = 'INSUFFICIENT_DATA' or short_term_status = 'INSUFFICIENT_DATA'"),
        )
    ),
)
register("run_metadata", lambda spark, d: (lambda x: report.run_metadata(x.constituents, x.store_analysts(), x.scored, CONFIG))(screen.from_testdata(spark, d)), o.metadata())
register("validation_counts", lambda spark, d: report.validation_counts(screen.from_testdata(spark, d).scored), o.validation())
register(
    "methodology",
    lambda spark, d: report.methodology_coverage(screen.from_testdata(spark, d).scored),
    f"{o.UP_TO_SCORED} select topic, description, case topic "
    + " ".join(f"when {o.q(t)} then (select count({c}) from scored)" for t, c in report.TOPIC_COLUMNS.items())
    + " else (select count(*) from scored) end as companies from (values "
    + ", ".join(f"({o.q(a)}, {o.q(b)})" for a, b in report.METHODOLOGY)
    + ") v(topic, description)",
)
register("ticker_detail", lambda spark, d: report.ticker_detail(screen.from_testdata(spark, d).scored.select(*DETAIL_COLUMNS), " s.3 "), f"{o.UP_TO_SCORED} {o.detail('S-3', DETAIL_COLUMNS)}")

SHOWN_COLUMNS = {"symbol": "s", "company_name": "s", "long_term_rank": "i", "short_term_rank": "i", "risk_flags": "s"} | dict.fromkeys(("analyst_long_term_score", "short_term_entry_score", "combined_score", "current_price", "selected_target_upside_pct", "positive_rating_pct", "rating_count", "average_dollar_volume_20d"), "double")
register(
    "ticker_display",
    lambda spark, d: report.ticker_display(screen.from_testdata(spark, d).scored.select(*SHOWN_COLUMNS), "s-7"),
    f"{o.UP_TO_SCORED}, one as (select * from scored where symbol = 'S-7') "
    + " union all ".join(
        f"select {o.q(c)} as field, "
        + (f"coalesce({c}::varchar, 'N/A') || '/' || (select count(*) from scored)" if c.endswith("_rank") else o.shown(c) if SHOWN_COLUMNS[c] == "double" else f"case when {c} = '' then 'None' else coalesce({c}, 'N/A') end")
        + " as value from one"
        for c in report.DETAIL
        if c in SHOWN_COLUMNS
    ),
)

# ---- order over all rows -----------------------------------------------------------------------------------------
LINE_KEYS = ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers of all line items, dearest first."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(*LINE_KEYS)
    return ordering.numbered(lines, [F.col(LINE_KEYS[0]).desc_nulls_last(), *(F.col(k).asc() for k in LINE_KEYS[1:])], "number")


register("line_numbers", _line_numbers, f"select row_number() over (order by l_extendedprice desc nulls last, {', '.join(LINE_KEYS[1:])}) as number, {', '.join(LINE_KEYS)} from lineitem")


def _line_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Minimum ranks of all line items by quantity and by discount, the latter among returned ones, and price percentiles by flag."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
    placed = ordering.percentile_in_group(lines, "l_extendedprice", "l_returnflag", "price_percentile")
    return rounded(ordering.min_ranks(placed, {"quantity_rank": ("l_quantity", F.lit(True)), "discount_rank": ("l_discount", F.col("l_returnflag") == "R")}, of=lines))


register(
    "line_ranks",
    _line_ranks,
    """select l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, round(l_extendedprice, 6) as l_extendedprice, rank() over (order by l_quantity desc) as quantity_rank,
  case when l_returnflag = 'R' then rank() over (partition by l_returnflag = 'R' order by l_discount desc) end as discount_rank,
  round((rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0) / count(*) over (partition by l_returnflag) * 100::double, 6) as price_percentile
from lineitem""",
)

# ---- single functions over computed inputs -----------------------------------------------------------------------
KNOTS = {
    "target_upside": scores.UPSIDE, "target_agreement": scores.AGREEMENT, "long_trend": scores.LONG_TREND, "coverage_confidence": scores.COVERAGE, "momentum_5d": scores.MOMENTUM_5D, "momentum_20d": scores.MOMENTUM_20D, "ma_distance": scores.MA_DISTANCE,
    "selloff_2d": scores.SELLOFF_2D, "red_days": scores.RED_DAYS, "worst_day": scores.WORST_DAY, "pullback": scores.PULLBACK, "absolute_volatility": scores.VOLATILITY, "sector_volatility": scores.SECTOR_VOLATILITY, "next_earnings": scores.NEXT_EARNINGS, "last_earnings": scores.LAST_EARNINGS,
}
#: An input from -110 to 110 in steps of 1/2 from a line item's part, NULL for some.
INPUT = "case when l_partkey % 19 = 7 then null else (l_partkey * 7 % 441) / 2e0 - 110 end"


def _inputs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", f"{INPUT} as x", *more)


for name, points in KNOTS.items():
    register(
        f"piecewise_{name}",
        lambda spark, d, points=points: _inputs(spark, d).select("l_orderkey", "l_linenumber", "x", F.round(exprs.piecewise(F.col("x"), points), 6).alias("score")),
        f"select l_orderkey, l_linenumber, x, round({o.knots('x', points)}, 6) as score from (select l_orderkey, l_linenumber, {INPUT} as x from lineitem)",
    )
RATING = {k: f"case when l_partkey % {m} = 1 then null else cast((l_partkey * {m}) % 11 - 2 as double) end" for k, m in (("strong_buy", 5), ("buy", 7), ("hold", 6), ("sell", 4), ("strong_sell", 3))}


def _sentiment(spark: SparkSession, d: str) -> DataFrame:
    df = _inputs(spark, d, *(f"{v} as {k}" for k, v in RATING.items()))
    return df.select("l_orderkey", "l_linenumber", *(F.round(v, 6).alias(k) for k, v in scores.sentiment(*(F.col(k) for k in RATING)).items()))


register(
    "sentiment",
    _sentiment,
    f"select l_orderkey, l_linenumber, round({o.clip(f'0.7::double * {o.POS} + 0.3::double * {o.STRENGTH}')}, 6) as score, round({o.POS}, 6) as positive, round(({o.SE} + {o.SS}) / {o.ALL} * 100, 6) as negative, round({o.HO} / {o.ALL} * 100, 6) as hold, round({o.STRENGTH}, 6) as strength"
    f" from (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in RATING.items())} from lineitem)",
)
EPS_IN = {"eps_up_30d": "case when l_partkey % 3 = 0 then null else cast(l_partkey % 8 - 1 as double) end", "eps_down_30d": "case when l_partkey % 5 = 0 then null else cast(l_suppkey % 6 - 1 as double) end"}


def _eps(spark: SparkSession, d: str) -> DataFrame:
    score, have = scores.eps_revisions(F.col("eps_up_30d"), F.col("eps_down_30d"))
    return _inputs(spark, d, *(f"{v} as {k}" for k, v in EPS_IN.items())).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), have.alias("available"))


register("eps_balance", _eps, f"select l_orderkey, l_linenumber, round({o.EPS}, 6) as score, eps_up_30d is not null or eps_down_30d is not null as available from (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in EPS_IN.items())} from lineitem)")
MOVES = {
    "return_2d_pct": "case when l_partkey % 4 = 0 then null else l_tax * 200 - 8 end", "return_5d_pct": "case when l_partkey % 5 = 0 then null else l_discount * 400 - 15 end", "return_20d_pct": "case when l_partkey % 7 = 0 then null else l_quantity - 20 end",
    "distance_from_ma20_pct": "case when l_partkey % 6 = 0 then null else l_discount * 400 - 15 end", "distance_from_ma50_pct": "case when l_partkey % 11 = 0 then null else l_quantity - 15 end", "negative_days_last_5": "case when l_partkey % 9 = 0 then null else cast(l_linenumber % 6 as double) end",
    "worst_daily_return_5d_pct": "case when l_partkey % 8 = 0 then null else l_tax * -130 end", "days_to_next_earnings": "case when l_partkey % 3 = 0 then null else l_quantity - 5 end", "days_since_last_earnings": "case when l_partkey % 2 = 0 then null else l_quantity end",
}


def _moves(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    selloff, coverage, status = scores.selloff_stability(c("return_2d_pct"), c("negative_days_last_5"), c("worst_daily_return_5d_pct"))
    df = _inputs(spark, d, *(f"{v} as {k}" for k, v in MOVES.items()))
    return df.select(
        "l_orderkey",
        "l_linenumber",
        F.round(scores.momentum(c("return_5d_pct"), c("return_20d_pct")), 6).alias("momentum"),
        F.round(scores.ma_alignment(c("distance_from_ma20_pct"), c("distance_from_ma50_pct")), 6).alias("ma_alignment"),
        F.round(selloff, 6).alias("selloff"),
        F.round(coverage, 6).alias("selloff_coverage"),
        status.alias("selloff_status"),
        F.round(scores.earnings_timing(c("days_to_next_earnings"), c("days_since_last_earnings")), 6).alias("earnings_timing"),
    )


register(
    "component_scores",
    _moves,
    f"select l_orderkey, l_linenumber, round({o.MOM}, 6) as momentum, round({o.MAA}, 6) as ma_alignment, round({o.SEL}, 6) as selloff, round({o.SELCOV}, 6) as selloff_coverage, case when {o.SELCOV} = 0 then 'INSUFFICIENT_DATA' when {o.SELCOV} < 100 then 'PARTIAL_DATA' else 'RANKED' end as selloff_status,"
    f" round({o.TIMING}, 6) as earnings_timing from (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in MOVES.items())} from lineitem)",
)
PARTS = {"a": "case when l_partkey % 3 = 0 then null else l_quantity * 3 - 20 end", "b": "case when l_partkey % 5 = 0 then null else l_discount * 1000 end", "c": "case when l_partkey % 7 = 0 then null else l_tax * 1000 end"}


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    score, coverage = exprs.weighted((F.col(k), w) for k, w in zip(PARTS, (50, 30, 20), strict=True))
    return _inputs(spark, d, *(f"{v} as {k}" for k, v in PARTS.items())).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), F.round(coverage, 6).alias("coverage"))


_W = o.weighted(zip(PARTS, (50, 30, 20), strict=True))
register("weighted_available", _weighted, f"select l_orderkey, l_linenumber, round({_W[0]}, 6) as score, round({_W[1]}, 6) as coverage from (select l_orderkey, l_linenumber, {', '.join(f'{v} as {k}' for k, v in PARTS.items())} from lineitem)")
register(
    "candidate_profiles",
    lambda spark, d: _inputs(spark, d, "case when l_partkey % 6 = 0 then null else l_quantity * 2 end as lt", "case when l_suppkey % 5 = 0 then null else l_discount * 1000 end as st").select(
        "l_orderkey", "l_linenumber", scores.candidate_profile(F.col("lt"), F.col("st")).alias("profile"), scores.category(F.col("lt"), scores.LONG_CATEGORIES).alias("long_category"), scores.category(F.col("st"), scores.SHORT_CATEGORIES).alias("short_category")
    ),
    f"select l_orderkey, l_linenumber, {o.profile('lt', 'st')} as profile, {o.cases('lt', scores.LONG_CATEGORIES)} as long_category, {o.cases('st', scores.SHORT_CATEGORIES)} as short_category from (select l_orderkey, l_linenumber, case when l_partkey % 6 = 0 then null else l_quantity * 2 end as lt, case when l_suppkey % 5 = 0 then null else l_discount * 1000 end as st from lineitem)",
)


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _inputs(spark, d).select("l_orderkey", "l_linenumber", *(F.round(v, 6).alias(k) for k, v in (("linear", legacy.linear_score(x, -50, 50)), ("pullback", legacy.pullback_score(x)), ("earnings", legacy.earnings_timing_score(x)), ("ma_distance", legacy.ma_distance_score(x)))))


register(
    "legacy_scores",
    _legacy,
    f"""select l_orderkey, l_linenumber, round({o.clip("(x + 50) / 100 * 100")}, 6) as linear,
  round(case when x >= -3 then 55e0 when x >= -8 then 100 when x >= -15 then 60 + (x + 15) / 7 * 40 when x >= -25 then 10 + (x + 25) / 10 * 50 when x is not null then 0 end, 6) as pullback,
  round(case when x is null then 50e0 when x < 0 then 70 when x <= 3 then 15 when x <= 7 then 35 when x <= 21 then 70 else 100 end, 6) as earnings,
  round(case when x is null then 50e0 when x < -15 then 5 when x < -5 then 5 + (x + 15) / 10 * 55 when x <= 5 then 60 + (x + 5) / 10 * 40 when x <= 15 then 100 - (x - 5) / 10 * 30 when x <= 30 then 70 - (x - 15) / 15 * 40 else 20 end, 6) as ma_distance
from (select l_orderkey, l_linenumber, {INPUT} as x from lineitem)""",
)

# ---- parsers -----------------------------------------------------------------------------------------------------
NUMBERS = ("12.5", " 7 ", "", "abc", "inf", "-Infinity", "NaN", "1e400", "-3", "1e3")
NUMBER = "case event_id % 11 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(NUMBERS)) + " end"
register(
    "safe_numeric_parse",
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{NUMBER} as raw").select("event_id", "raw", exprs.finite(F.trim("raw")).alias("value")),
    f"select event_id, raw, case when isfinite(try_cast(trim(raw) as double)) then try_cast(trim(raw) as double) end as value from (select event_id, {NUMBER} as raw from events)",
)
HEADERS = ("strongBuy", "strong_buy", "Strong Buy", "strong-buy", " upLast7days ", "GICS Sector", "CIK")
HEADER = "case event_id % 7 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(HEADERS)) + " end"
register(
    "normalize_headers",
    lambda spark, d: spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{HEADER} as raw").select("event_id", parse.normalize_name(F.col("raw")).alias("name"), parse.normalize_symbol(F.concat("raw", F.lit(".B "))).alias("symbol")),
    f"select event_id, lower(translate(substr(trim(raw), 1, 1) || regexp_replace(substr(trim(raw), 2), '([A-Z])', '_\\1', 'g'), ' -', '__')) as name, translate(trim(raw || '.B '), '.', '-') as symbol from (select event_id, {HEADER} as raw from events)",
)
PAIRS = "map('Current', '11', 'mean Price', cast(value as string), 'meanPrice', 'x', 'High', 'NaN')"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr("cast(event_id as string) as symbol", f"case when event_id % 3 = 0 then map('low', '1', 'low_price', '2') when event_id % 3 = 1 then {PAIRS} else map('median', 'bad', 'median_price', '5') end as kv")
    return rounded(parse.parse_targets(raw))


register(
    "alias_pick_targets",
    _targets,
    """select event_id::varchar as symbol, case when event_id % 3 = 1 then 11e0 end as target_current, case when event_id % 3 = 0 then 1e0 end as target_low, null::double as target_mean, null::double as target_median, null::double as target_high from events""",
)
PERIODS = "case when event_id % 4 = 1 then ' 0M ' when event_id % 4 = 2 then '-1m' else '0m' end"


def _recommendations(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr("cast(user_id as string) as symbol", "event_id as ordinal", f"case when user_id % 5 = 0 then '-2m' else {PERIODS} end as period", "map('strongBuy', cast(event_id as string), 'Buy', '2', 'sell', 'x') as kv")
    return rounded(parse.parse_recommendations(raw))


register(
    "pick_current_recommendation",
    _recommendations,
    f"""select symbol, ordinal::double as strong_buy, 2e0 as buy, null::double as hold, null::double as sell, null::double as strong_sell, period as recommendation_period from (
  select *, row_number() over (partition by symbol order by lower(period) = '0m' desc, ordinal) as rn from (select user_id::varchar as symbol, event_id as ordinal, case when user_id % 5 = 0 then '-2m' else {PERIODS} end as period from events)) where rn = 1""",
)


def _eps_rows(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr("cast(user_id as string) as symbol", "event_id as ordinal", "case when event_id % 6 = 5 then ' 0q' else '+1q' end as index_label", "map('upLast7days', cast(event_id as string), 'up_last_30_days', '3', 'downLast30days', '4') as kv")
    return rounded(parse.parse_eps_revisions(raw))


register(
    "pick_current_eps",
    _eps_rows,
    """select symbol, ordinal::double as eps_up_7d, 3e0 as eps_up_30d, null::double as eps_down_7d, 4e0 as eps_down_30d, label as eps_revision_period from (
  select *, row_number() over (partition by symbol order by trim(label) = '0q' desc, ordinal) as rn from (select user_id::varchar as symbol, event_id as ordinal, case when event_id % 6 = 5 then ' 0q' else '+1q' end as label from events)) where rn = 1""",
)
register(
    "next_event_date",
    lambda spark, d: parse.next_earnings_date(spark.read.parquet(f"{d}/events.parquet").selectExpr("cast(user_id as string) as symbol", "case when event_id % 9 = 0 then 'zz' else cast(ts as string) end as ts"), "2024-01-28 00:00:00").withColumn("next_earnings_date", F.col("next_earnings_date").cast("timestamp_ntz")),
    "select user_id::varchar as symbol, min(case when event_id % 9 <> 0 and ts >= TIMESTAMP '2024-01-27 12:00:00' then ts end) as next_earnings_date from events group by user_id",
)


#: Payload rows of user_id as the symbol, one an event: which call it is of, its label, fields, date and error.
CALL = "case event_id % 5 when 0 then 'quote' when 1 then 'targets' when 2 then 'recommendations' when 3 then 'eps_revisions' else 'earnings_dates' end"
FAILED = "case when event_id % 5 > 0 and event_id % 23 = 9 then concat('Timeout: ', cast(event_id as {text})) when user_id % 29 = 11 and event_id % 5 = 0 then 'ValueError: x' end"
PAYLOAD_LABEL = "case event_id % 5 when 2 then case event_id % 3 when 0 then '0M' when 1 then ' 0m' else '-1m' end when 3 then case when event_id % 4 = 1 then ' 0Q ' else '+1q' end end"
PAYLOAD_DATE = "case when event_id % 5 < 4 then null when event_id % 9 = 0 then 'zz' when event_id % 9 = 1 then concat(replace(cast(ts as {text}), ' ', 'T'), 'Z') when event_id % 9 = 2 then concat(cast(ts as {text}), '+05:30') when event_id % 9 = 3 then concat(cast(ts as {text}), '-0500') else cast(ts as {text}) end"
PAYLOAD_KV = """case event_id % 5
  when 0 then case event_id % 3 when 0 then map('lastPrice', 'NaN', 'regularMarketPrice', cast(event_id as string)) when 1 then map('last_price', cast(event_id as string)) else null end
  when 1 then map('current', cast(event_id as string), 'lowPrice', '2.5', 'mean', 'x', 'meanPrice', '4', 'high', cast(null as string))
  when 2 then map('strongBuy', cast(event_id as string), 'Buy', '2', 'hold', 'inf', 'strongsell', '1')
  when 3 then map('upLast7days', cast(event_id as string), 'up_last_30_days', '3', 'downLast30days', '4') end"""


def _analyst_rows(spark: SparkSession, d: str) -> DataFrame:
    call = "case when user_id % 29 = 11 and event_id % 5 = 0 then 'unhandled' else " + CALL + " end as call"
    dialect = {"text": "string"}
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "cast(user_id as string) as symbol", call, "event_id as ordinal", f"{PAYLOAD_LABEL} as label", f"{PAYLOAD_KV} as kv", f"{PAYLOAD_DATE.format(**dialect)} as text", f"{FAILED.format(**dialect)} as error", "ts as fetched_at"
    )
    return rounded(analysts.assemble(raw, "2024-01-15 00:00:00"))


register(
    "analyst_relation",
    _analyst_rows,
    f"""with e as (select user_id, event_id, ts, user_id::varchar as symbol, case when user_id % 29 = 11 and event_id % 5 = 0 then 'unhandled' else {CALL} end as call, {PAYLOAD_LABEL} as label, {FAILED.format(text="varchar")} as error from events),
ok as (select *, row_number() over (partition by symbol, call order by case when call = 'recommendations' then coalesce(lower(label) = '0m', false) when call = 'eps_revisions' then lower(trim(label)) = '0q' else false end desc, event_id) as rn from e where error is null),
one as (select symbol, max(case when call = 'quote' and event_id % 3 < 2 then event_id end)::double as quote, max(case when call = 'targets' then event_id end)::double as target, max(case when call = 'recommendations' then event_id end)::double as rec,
  max(case when call = 'recommendations' then label end) as rec_label, max(case when call = 'eps_revisions' then event_id end)::double as eps, max(case when call = 'eps_revisions' then label end) as eps_label from ok where rn = 1 group by symbol),
due as (select user_id::varchar as symbol, case event_id % 9 when 0 then null when 2 then ts - interval 330 minute when 3 then ts + interval 5 hour else ts end as due_at from events where event_id % 5 = 4),
days as (select symbol, min(due_at) as due_at from due where due_at >= timestamp '2024-01-14 12:00:00' group by symbol),
said as (select symbol, max(case when call = 'targets' then 'targets=' || error end) as a, max(case when call = 'recommendations' then 'recommendations=' || error end) as b, max(case when call = 'eps_revisions' then 'eps_revisions=' || error end) as c,
  max(case when call = 'earnings_dates' then 'earnings_dates=' || error end) as d, max(case when call = 'unhandled' then error end) as broken, max(ts) as fetched from e group by symbol)
select s.symbol, case when broken is null then quote end as latest_quote, case when broken is null then target end as target_current, case when broken is null and target is not null then 2.5::double end as target_low, null::double as target_mean, null::double as target_median, null::double as target_high,
  case when broken is null then rec end as strong_buy, case when broken is null and rec is not null then 2::double end as buy, null::double as hold, null::double as sell, case when broken is null and rec is not null then 1::double end as strong_sell,
  case when broken is null then coalesce(rec_label, '') else '' end as recommendation_period, case when broken is null then eps end as eps_up_7d, case when broken is null and eps is not null then 3::double end as eps_up_30d, null::double as eps_down_7d, case when broken is null and eps is not null then 4::double end as eps_down_30d,
  case when broken is null then coalesce(eps_label, '') else '' end as eps_revision_period, case when broken is null then due_at end as next_earnings_date, fetched as data_fetched_at_utc,
  case when broken is not null then 'UNHANDLED=' || broken else concat_ws(' | ', a, b, c, d) end as data_errors
from said s left join one o on s.symbol = o.symbol left join days y on s.symbol = y.symbol""",
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
