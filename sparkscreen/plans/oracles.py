"""DuckDB SQL for the registered queries of the screen, from the same constants but written in SQL throughout."""

from __future__ import annotations

from ..config import MODEL_VERSION
from ..functions import scores as s
from ..operators import rank, report
from ..sources import testdata as t

RUN = f"TIMESTAMP '{t.RUN_TS}'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def relation(text: str) -> str:
    out = t.text(text, t.DUCKDB)
    for name in ("supplier", "nation", "region", "lineitem", "orders"):
        out = out.replace("{" + name + "}", name)
    return out


def knots(x: str, points) -> str:
    points = sorted(points)
    (x0, y0), *rest = points
    out = f"case when {x} is null then null when {x} <= {x0} then {y0}e0"
    for x1, y1 in rest:
        out += f" when {x} <= {x1} then {y0} + ({x} - {x0}) * ({(y1 - y0) / (x1 - x0)!r}::double)"
        x0, y0 = x1, y1
    return f"({out} else {y0}e0 end)"


def clip(x: str, low: float = 0, high: float = 100) -> str:
    return f"(case when ({x}) is not null then least(greatest({x}, {low}), {high}) end)"


def weighted(parts) -> tuple[str, str]:
    parts = list(parts)
    have = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in parts)
    total = " + ".join(f"(case when {c} is not null then {w} else 0 end)" for c, w in parts)
    return clip(f"({have}) / nullif({total}, 0)"), f"(({total}) * 100.0::double / {sum(w for _, w in parts)})"


def over(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0) - 1) * 100"


def cases(x: str, steps) -> str:
    return "case when " + x + " is null then 'INSUFFICIENT DATA' " + " ".join(f"when {x} < {b} then {q(n)}" if b is not None else f"else {q(n)}" for b, n in steps) + " end"


def profile(lt: str, st: str) -> str:
    return (
        f"case when {lt} is null and {st} is null then 'INSUFFICIENT DATA' when {lt} is null then 'TECHNICAL ONLY' when {st} is null then 'ANALYST VIEW ONLY' "
        f"when {lt} >= 75 and {st} >= 75 then 'STRONG CANDIDATE' when {lt} >= 75 and {st} < 40 then 'ATTRACTIVE BUT TECHNICALLY WEAK' when {lt} >= 75 and {st} < 60 then 'ATTRACTIVE, WAIT FOR ENTRY' "
        f"when {lt} >= 60 and {st} >= 75 then 'TACTICAL CANDIDATE' when {lt} < 60 and {st} >= 75 then 'MOMENTUM ONLY' when {lt} >= 60 and {st} >= 60 then 'RESEARCH CANDIDATE' else 'LOW PRIORITY' end"
    )


CON, BARS, ANA = (f"{n} as ({relation(x)})" for n, x in (("constituents", t.CONSTITUENTS), ("bars", t.BARS), ("analysts", t.ANALYSTS)))
NUMBERED = """numbered as (
  select symbol, price_date, seq, close, volume, row_number() over w as ra,
    case when close is not null then count(close) over (w rows between unbounded preceding and current row) end as rn,
    case when close is not null then close / nullif(lead(close ignore nulls) over w, 0) - 1 end as ret
  from bars window w as (partition by symbol order by seq desc))"""


def mean(k: int) -> str:
    return f"case when count(close) >= {k} then avg(case when rn <= {k} then close end) end"


def std(k: int) -> str:
    return f"case when count(ret) >= 20 then stddev_samp(case when rn <= {k} then ret end) * sqrt(252) * 100 end"


PRICES = f"""prices as (
  select c.symbol, hp as history_price, price_as_of, ma_20, ma_50, ma_200, {over("hp", "ma_200")} as price_vs_200d_ma_pct, volatility_annual_pct,
    case when hp is not null then av end as average_volume_20d, hp * av as average_dollar_volume_20d,
    case when n is null then 'NO_PRICE_HISTORY' when hp is null then 'NO_VALID_CLOSE' else '' end as history_error
  from constituents c left join (
    select symbol, count(close) as n, max(case when rn = 1 then close end) as hp, max(case when rn = 1 then price_date end) as price_as_of, {mean(20)} as ma_20, {mean(50)} as ma_50, {mean(200)} as ma_200,
      {std(252)} as volatility_annual_pct, case when count(volume) > 0 then avg(case when ra <= 20 then volume end) end as av from numbered group by symbol) a on c.symbol = a.symbol)"""
SHORT = f"""short as (
  select symbol, p as short_price, {", ".join(f"{over('p', f'c{k}')} as return_{k}d_pct" for k in (1, 2, 5, 20))}, short_ma_20, short_ma_50, {over("p", "short_ma_20")} as distance_from_ma20_pct,
    {over("p", "short_ma_50")} as distance_from_ma50_pct, {over("p", "high_20")} as drawdown_from_20d_high_pct, v as short_volatility_20d_pct, v as volatility_20d_annualized_pct, negative_days_last_5, worst_daily_return_5d_pct
  from (select symbol, max(case when rn = 1 then close end) as p, {", ".join(f"max(case when rn = {k + 1} then close end) as c{k}" for k in (1, 2, 5, 20))}, {mean(20)} as short_ma_20, {mean(50)} as short_ma_50,
      case when count(close) >= 20 then max(case when rn <= 20 then close end) end as high_20, {std(20)} as v,
      case when count(ret) >= 5 then count(case when rn <= 5 and ret < 0 then 1 end)::double end as negative_days_last_5, case when count(ret) >= 5 then min(case when rn <= 5 then ret end) * 100 end as worst_daily_return_5d_pct
    from numbered group by symbol) where p is not null)"""


def counts(cols) -> list[str]:
    return [f"coalesce(greatest({c}, 0), 0)" for c in cols]


SB, BU, HO, SE, SS = counts(("strong_buy", "buy", "hold", "sell", "strong_sell"))
ALL = f"nullif({SB} + {BU} + {HO} + {SE} + {SS}, 0)"
POS, STRENGTH = f"(({SB} + {BU}) / {ALL} * 100)", f"((100 * {SB} + 80 * {BU} + 50 * {HO} + 20 * {SE}) / {ALL})"
UP, DOWN = counts(("eps_up_30d", "eps_down_30d"))
EPS = f"(case when eps_up_30d is null and eps_down_30d is null then null when {UP} + {DOWN} = 0 then 50e0 else {clip(f'(({UP} - {DOWN}) / greatest({UP} + {DOWN}, 1) + 1) / 2 * 100')} end)"
ANALYSIS = f"""joined as (select c.*, p.* exclude (symbol), a.* exclude (symbol), coalesce(latest_quote, history_price) as current_price, coalesce(target_median, target_mean) as selected_target_price,
    coalesce(strong_buy, 0) + coalesce(buy, 0) + coalesce(hold, 0) + coalesce(sell, 0) + coalesce(strong_sell, 0) as rating_count, date_diff('microsecond', {RUN}, next_earnings_date) / 86400e6 as days_to_earnings
  from constituents c left join prices p on c.symbol = p.symbol left join analysts a on c.symbol = a.symbol),
analysis as (select *,
    case when latest_quote is not null then 'FRESH_FAST_INFO' when history_price is not null then 'FRESH_DAILY_CLOSE_FALLBACK' else 'MISSING' end as current_price_source,
    selected_target_price as selected_target, case when target_median is not null then 'MEDIAN' when target_mean is not null then 'MEAN_FALLBACK' else 'MISSING' end as selected_target_source, selected_target_source as selected_target_type,
    case when current_price > 0 then {over("selected_target_price", "current_price")} end as selected_target_upside_pct,
    {POS} as positive_rating_pct, ({SE} + {SS}) / {ALL} * 100 as negative_rating_pct, {HO} / {ALL} * 100 as hold_rating_pct, {clip(f"0.7::double * {POS} + 0.3::double * {STRENGTH}")} as lt_score_sentiment, {STRENGTH} as recommendation_strength_score,
    (2 * coalesce(strong_buy, 0) + coalesce(buy, 0) - coalesce(sell, 0) - 2 * coalesce(strong_sell, 0)) / nullif(2 * rating_count, 0) as recommendation_score_simple,
    {over("target_mean", "target_median")} as mean_vs_median_pct, (target_high - target_low) / nullif(selected_target_price, 0) * 100 as target_dispersion_pct,
    days_to_earnings as days_to_next_earnings, case when days_to_earnings < 0 then abs(days_to_earnings) end as days_since_last_earnings
  from joined)"""
PARTIAL = "current_price is null or selected_target_price is null or rating_count < 5"
FLAGS = (
    ("MISSING_CURRENT_PRICE", "current_price is null"), ("MISSING_ANALYST_TARGET", "selected_target_price is null"), ("MISSING_RECOMMENDATIONS", "rating_count = 0"), ("LOW_ANALYST_COVERAGE", "rating_count < 10"),
    ("HIGH_TARGET_DISAGREEMENT", "target_dispersion_pct > 50"), ("EXTREME_TARGET_UPSIDE", "selected_target_upside_pct >= 80"), ("EARNINGS_WITHIN_3_DAYS", "days_to_next_earnings between 0 and 3"),
    ("EARNINGS_WITHIN_7_DAYS", "days_to_next_earnings between 0 and 7"), ("POST_EARNINGS_PRICE_DISCOVERY", "days_since_last_earnings between 0 and 5"), ("NEGATIVE_EPS_REVISIONS", "eps_down_30d > eps_up_30d"),
    ("BELOW_200D_MA", "current_price < ma_200"), ("HIGH_VOLATILITY", "volatility_annual_pct > 60"), ("VERY_LOW_LIQUIDITY", "average_dollar_volume_20d < 5000000"), ("LOW_LIQUIDITY", "average_dollar_volume_20d < 10000000"),
    ("SHARP_RECENT_SELLOFF", "return_5d_pct <= -10"), ("SHORT_TERM_OVEREXTENDED", "return_5d_pct >= 15"), ("EXTREME_OVEREXTENSION", "return_20d_pct >= 40"), ("PARTIAL_DATA", PARTIAL),
    ("OPTIONAL_DATA_MISSING", f"not ({PARTIAL}) and (trim(coalesce(history_error, 'nan')) <> '' or trim(coalesce(data_errors, 'nan')) <> '')"),
)
FLAG_SQL = "concat_ws('|', " + ", ".join(f"case when {c} then '{n}' end" for n, c in FLAGS) + ")"
MOM, _ = weighted(zip((knots("return_5d_pct", s.MOMENTUM_5D), knots("return_20d_pct", s.MOMENTUM_20D)), s.MOMENTUM_WEIGHTS, strict=True))
MAA, _ = weighted(zip((knots("distance_from_ma20_pct", s.MA_DISTANCE), knots("distance_from_ma50_pct", s.MA_DISTANCE)), s.MA_WEIGHTS, strict=True))
SEL, SELCOV = weighted(zip((knots("return_2d_pct", s.SELLOFF_2D), knots("negative_days_last_5", s.RED_DAYS), knots("worst_daily_return_5d_pct", s.WORST_DAY)), s.SELLOFF_WEIGHTS, strict=True))
TIMING = f"(case when days_to_next_earnings >= 0 then {knots('days_to_next_earnings', s.NEXT_EARNINGS)} when days_since_last_earnings >= 0 then {knots('days_since_last_earnings', s.LAST_EARNINGS)} end)"
LONG, LONGCOV = weighted((f"lt_score_{k}", w) for k, w in s.LONG_WEIGHTS.items())
SHRT, SHRTCOV = weighted((f"st_score_{k}", w) for k, w in s.SHORT_WEIGHTS.items())
ABLE = "in ('RANKED', 'PARTIAL_DATA')"


def drivers() -> tuple[str, str]:
    good = [f"case when {c} >= 75 then {q('Strong ' + n)} end" for c, n in s.DRIVERS]
    bad = [f"case when {c} <= 35 then {q('Weak ' + n)} end" for c, n in s.DRIVERS] + [f"case when list_contains(string_split(risk_flags, '|'), '{f}') then {q(x)} end" for f, x in s.FLAG_TEXTS]
    joined = lambda parts, none: f"coalesce(nullif(concat_ws('; ', {', '.join(parts)}), ''), {q(none)})"
    return joined(good, s.NO_POSITIVE), joined(bad, s.NO_NEGATIVE)


GOOD, BAD = drivers()
PERCENTILE = """ranked_vol as (select *, case when sector is not null and short_volatility_20d_pct is not null and count(short_volatility_20d_pct) over (partition by sector) >= 5 then
    (rank() over (partition by sector, short_volatility_20d_pct is null order by short_volatility_20d_pct) + (count(*) over (partition by sector, short_volatility_20d_pct) - 1) / 2.0)
    / count(short_volatility_20d_pct) over (partition by sector) * 100::double end as sector_volatility_percentile
  from analysis a left join short s using (symbol))"""
SCORED = f"""{PERCENTILE},
parts as (select *, {knots("selected_target_upside_pct", s.UPSIDE)} as lt_score_upside, {EPS} as lt_score_eps_revisions, eps_up_30d is not null or eps_down_30d is not null as eps_revision_data_available,
    {knots("target_dispersion_pct", s.AGREEMENT)} as lt_score_target_agreement, {knots("price_vs_200d_ma_pct", s.LONG_TREND)} as lt_score_long_trend, {knots("rating_count", s.COVERAGE)} / 100 as analyst_coverage_confidence,
    {MOM} as st_score_momentum, {MAA} as st_score_ma_alignment, {knots("drawdown_from_20d_high_pct", s.PULLBACK)} as st_score_pullback_quality, {SEL} as st_score_selloff_stability, {SELCOV} as selloff_stability_data_coverage_pct,
    case when {SELCOV} = 0 then 'INSUFFICIENT_DATA' when {SELCOV} < 100 then 'PARTIAL_DATA' else 'RANKED' end as selloff_stability_status,
    case when sector_volatility_percentile is not null then {knots("sector_volatility_percentile", s.SECTOR_VOLATILITY)} else {knots("short_volatility_20d_pct", s.VOLATILITY)} end as st_score_volatility,
    case when sector_volatility_percentile is not null then 'SECTOR_RELATIVE' else 'ABSOLUTE_FALLBACK' end as volatility_scoring_method, distance_from_ma20_pct as price_vs_ma20_pct, distance_from_ma50_pct as price_vs_ma50_pct, {TIMING} as st_score_earnings_timing
  from ranked_vol),
raws as (select *, {LONG} as lt, {LONGCOV} as analyst_long_term_data_coverage_pct, {SHRT} as st, {SHRTCOV} as short_term_data_coverage_pct from parts),
statuses as (select *,
    case when current_price is null or selected_target_price is null or rating_count < 5 or analyst_long_term_data_coverage_pct < 70 then 'INSUFFICIENT_DATA' when analyst_long_term_data_coverage_pct < 100 then 'PARTIAL_DATA' else 'RANKED' end as analyst_long_term_status,
    case when current_price is null or return_5d_pct is null or return_20d_pct is null or distance_from_ma20_pct is null or distance_from_ma50_pct is null or short_volatility_20d_pct is null or drawdown_from_20d_high_pct is null or short_term_data_coverage_pct < 75
      then 'INSUFFICIENT_DATA' when short_term_data_coverage_pct < 100 then 'PARTIAL_DATA' else 'RANKED' end as short_term_status,
    {clip("0.7::double + 0.3::double * analyst_coverage_confidence", 0, 1)} as analyst_coverage_multiplier,
    (case when average_dollar_volume_20d < 5000000 then 5e0 when average_dollar_volume_20d < 10000000 then 3e0 when average_dollar_volume_20d < 20000000 then 1e0 else 0e0 end) + (case when volatility_annual_pct > 60 then 1e0 else 0e0 end)
      + (case when selected_target_upside_pct >= 80 then 2e0 else 0e0 end) + (case when target_dispersion_pct > 50 then 2e0 else 0e0 end) as long_term_risk_penalty,
    (case when average_dollar_volume_20d < 5000000 then 10e0 else 0e0 end) + (case when return_5d_pct <= -10 then 3e0 else 0e0 end) + (case when return_20d_pct >= 40 then 3e0 else 0e0 end) as short_term_risk_penalty
  from raws),
finals as (select *, case when analyst_long_term_status <> 'INSUFFICIENT_DATA' then lt end as analyst_long_term_raw_score, case when short_term_status <> 'INSUFFICIENT_DATA' then st end as short_term_raw_score,
    {clip("analyst_long_term_raw_score * analyst_coverage_multiplier - long_term_risk_penalty")} as analyst_long_term_score, {clip("short_term_raw_score - short_term_risk_penalty")} as short_term_entry_score,
    {FLAG_SQL} as risk_flags from statuses),
profiled as (select * exclude (lt, st), analyst_long_term_score as long_term_score, {cases("analyst_long_term_score", s.LONG_CATEGORIES)} as analyst_long_term_category, {cases("short_term_entry_score", s.SHORT_CATEGORIES)} as short_term_category,
    {profile("analyst_long_term_score", "short_term_entry_score")} as candidate_profile, 0.6::double * analyst_long_term_score + 0.4::double * short_term_entry_score as combined_score,
    case when analyst_long_term_status = 'RANKED' and short_term_status = 'RANKED' and analyst_long_term_data_coverage_pct >= 90 and short_term_data_coverage_pct >= 90 then 'HIGH'
      when analyst_long_term_status {ABLE} and short_term_status {ABLE} then 'MEDIUM' when analyst_long_term_status {ABLE} or short_term_status {ABLE} then 'LOW' else 'INSUFFICIENT' end as overall_data_quality from finals),
scored as (select *, analyst_long_term_category as long_term_category, case candidate_profile {" ".join(f"when {q(k)} then {q(v)}" for k, v in s.PROFILE_TEXTS.items())} end as candidate_profile_explanation,
    case candidate_profile {" ".join(f"when {q(k)} then {v}" for k, v in s.PRIORITIES.items())} else 99 end as candidate_profile_priority, risk_flags like '%PARTIAL_DATA%' as has_partial_data, {GOOD} as top_positive_drivers, {BAD} as top_negative_drivers,
    case when analyst_long_term_status {ABLE} then (rank() over (partition by analyst_long_term_status {ABLE} order by analyst_long_term_score desc nulls last))::int end as long_term_rank,
    case when short_term_status {ABLE} then (rank() over (partition by short_term_status {ABLE} order by short_term_entry_score desc nulls last))::int end as short_term_rank from profiled)"""


def order(keys) -> str:
    return ", ".join(f"{k} desc nulls last" for k in keys) + ", ordinal"


COMBINED = f"""combined as (select (row_number() over (order by candidate_profile_priority, {order(rank.COMBINED_KEYS[1:])}))::int as combined_rank, * from scored
  where analyst_long_term_score >= 60 and short_term_entry_score >= 60 and analyst_long_term_status {ABLE} and short_term_status {ABLE} and analyst_long_term_data_coverage_pct >= 80 and short_term_data_coverage_pct >= 80 and overall_data_quality <> 'INSUFFICIENT')"""
UP_TO_ANALYSIS = f"with {CON}, {BARS}, {ANA}, {NUMBERED}, {PRICES}, {ANALYSIS}"
UP_TO_SCORED = f"{UP_TO_ANALYSIS}, {SHORT}, {SCORED}"


def rounded(columns: dict[str, str]) -> str:
    """Select list: doubles rounded to 6 places."""
    return ", ".join(f"round({c}, 6) as {c}" if kind == "double" else c for c, kind in columns.items())


def top(table: str, columns, keys: str, n: int, doubles: set[str]) -> str:
    return f"select {', '.join(f'round_even({c}, 2) as {c}' if c in doubles else c for c in columns)} from (select * from {table} order by {keys} limit {n})"


def shown(c: str) -> str:
    """A number with separators and 2 places."""
    whole = f"(round_even(abs({c}) * 100, 0) / 100)"
    cents = f"lpad(((round_even(abs({c}) * 100, 0)::bigint) % 100)::varchar, 2, '0')"
    digits = f"floor({whole} + 1e-9)::bigint::varchar"
    grouped = f"regexp_replace(reverse(regexp_replace(reverse({digits}), '([0-9]{{3}})', '\\1,', 'g')), '^,', '')"
    return f"coalesce(case when {c} < 0 then '-' else '' end || {grouped} || '.' || {cents} || '{'%' if c.endswith('_pct') else ''}', 'N/A')"


def detail(symbol: str, columns: list[str]) -> str:
    return f"select field, value from (unpivot (select {', '.join(f'{c}::varchar as {c}' for c in columns)} from scored where symbol = {q(symbol)}) on {', '.join(columns)} into name field value value)"


def metadata() -> str:
    rows = [
        ("run_timestamp_utc", q(t.RUN_TS)), ("scoring_model_version", q(MODEL_VERSION)), ("sp500_constituents", "(select count(*) from constituents)"), ("successful_price_rows", "(select count(history_price) from prices)"),
        ("complete_price_history_symbols", f"(select count(*) from scored where short_term_status {ABLE})"), ("analyst_data_rows", "(select count(*) from analysts)"),
        ("ranked_long_term", f"(select count(*) from scored where analyst_long_term_status {ABLE})"), ("ranked_short_term", f"(select count(*) from scored where short_term_status {ABLE})"),
        ("partial_data_rows", "(select count(*) from scored where analyst_long_term_status = 'PARTIAL_DATA' or short_term_status = 'PARTIAL_DATA')"),
        ("insufficient_data_rows", "(select count(*) from scored where overall_data_quality = 'INSUFFICIENT')"), ("data_sources", q(report.DATA_SOURCES)), ("script_version", q(MODEL_VERSION)),
    ]
    return UP_TO_SCORED + " " + " union all ".join(f"select {q(k)} as field, ({v})::varchar as value" for k, v in rows)


def validation() -> str:
    rows = [(f"outside_{c}", f"scored where {c} not between 0 and 100") for c in report.SCORES] + [
        ("scored_insufficient_long", "scored where analyst_long_term_status = 'INSUFFICIENT_DATA' and analyst_long_term_score is not null"),
        ("scored_insufficient_short", "scored where short_term_status = 'INSUFFICIENT_DATA' and short_term_entry_score is not null"),
        ("low_combined", "combined where analyst_long_term_score < 60 or short_term_entry_score < 60"),
    ]
    return f"{UP_TO_SCORED}, {COMBINED} " + " union all ".join(f"select {q(k)} as invariant, (select count(*) from {v}) as broken" for k, v in rows)
