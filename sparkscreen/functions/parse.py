"""Parsers: header and symbol normalization, alias picks, rows chosen by period, the next earnings date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import finite

# Alternative names of a field, in order of preference.
TARGET_KEYS = {
    "target_current": ("current", "current_price"),
    "target_low": ("low", "low_price"),
    "target_mean": ("mean", "mean_price"),
    "target_median": ("median", "median_price"),
    "target_high": ("high", "high_price"),
}
RATING_KEYS = {"strong_buy": ("strong_buy", "strongbuy"), "buy": ("buy",), "hold": ("hold",), "sell": ("sell",), "strong_sell": ("strong_sell", "strongsell")}
#: The last spelling of each is what ``upLast7days`` normalizes to.
EPS_KEYS = {
    "eps_up_7d": ("up_last_7_days", "uplast7days", "up_last7days"),
    "eps_up_30d": ("up_last_30_days", "uplast30days", "up_last30days"),
    "eps_down_7d": ("down_last_7_days", "downlast7days", "down_last7days", "down_last7_days"),
    "eps_down_30d": ("down_last_30_days", "downlast30days", "down_last30days", "down_last30_days"),
}
QUOTE_KEYS = ("last_price", "lastPrice", "regular_market_price", "regularMarketPrice")


def normalize_name(c: Column) -> Column:
    """Header to snake case: an underscore before each capital but the first character, blanks and dashes to underscores."""
    return F.lower(F.translate(F.regexp_replace(F.trim(c), r"(?<!^)(?=[A-Z])", "_"), " -", "__"))


def normalize_symbol(c: Column) -> Column:
    return F.translate(F.trim(c), ".", "-")


def normalize_map(kv: Column) -> Column:
    """A map with normalized keys; of keys that then are equal the last wins."""
    entries = F.transform(F.map_entries(kv), lambda e: F.struct(normalize_name(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def pick(kv: Column, keys: tuple[str, ...]) -> Column:
    """The number under the first key that is there, even if it is not a number."""
    out = F.lit(None).cast("double")
    for k in reversed(keys):
        out = F.when(F.map_contains_key(kv, k), finite(F.element_at(kv, k))).otherwise(out)
    return out


def parse_targets(raw: DataFrame) -> DataFrame:
    """raw: symbol, kv map<string,string>."""
    named = raw.select("symbol", normalize_map(F.col("kv")).alias("kv"))
    return named.select("symbol", *(pick(F.col("kv"), keys).alias(name) for name, keys in TARGET_KEYS.items()))


def quote_price(kv: Column) -> Column:
    """The first finite price of a quote."""
    return F.coalesce(*(finite(F.try_element_at(kv, F.lit(k))) for k in QUOTE_KEYS))


def is_label(label: Column, wanted: str, trim: bool = True) -> Column:
    return F.coalesce(F.lower(F.trim(label) if trim else label) == wanted, F.lit(False))


def pick_row(raw: DataFrame, label: str, wanted: str, trim: bool = True) -> DataFrame:
    """One row a symbol: the first whose label is wanted, else the first, by ordinal. Tasks pick among their own rows first."""
    order = F.struct(~is_label(F.col(label), wanted, trim), F.col("ordinal"))
    return raw.groupBy("symbol").agg(F.min_by(F.struct(*raw.columns), order).alias("row")).select("row.*")


def parse_recommendations(raw: DataFrame) -> DataFrame:
    """raw: symbol, ordinal, period, kv of the counts. A period with blanks around it is not the current one; an EPS label may have them."""
    rows = pick_row(raw, "period", "0m", trim=False).withColumn("kv", normalize_map(F.col("kv")))
    return rows.select("symbol", *(pick(F.col("kv"), keys).alias(name) for name, keys in RATING_KEYS.items()), F.coalesce("period", F.lit("")).alias("recommendation_period"))


def parse_eps_revisions(raw: DataFrame) -> DataFrame:
    """raw: symbol, ordinal, index_label, kv of the counts."""
    rows = pick_row(raw, "index_label", "0q").withColumn("kv", normalize_map(F.col("kv")))
    return rows.select("symbol", *(pick(F.col("kv"), keys).alias(name) for name, keys in EPS_KEYS.items()), F.coalesce("index_label", F.lit("")).alias("eps_revision_period"))


#: How a date begins, a time of day, and a zone that ends it.
DATE, TIME, ZONE = r"^\d{4}(-\d{1,2}){0,2}([T ]|$)", r"\d{1,2}:\d{2}(:\d{2}(\.\d*)?)?", r"\s*([Zz]|UTC|GMT|[+-]\d{1,2}(:?\d{2})?|[A-Za-z_]+(/[A-Za-z_]+)+)$"


def utc(c: Column) -> Column:
    """The UTC wall-clock time of an instant, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def instant(text: Column) -> Column:
    """The UTC time of a text as timestamp_ntz, whatever the session's zone: a text without a zone is UTC. NULL if it is no date."""
    text = F.trim(text)
    zoned = F.regexp_like(text, F.lit(TIME + ZONE))
    seconds = F.regexp_replace(text, r"([T ]\d{1,2}:\d{2})(?![:\d])", "$1:00")
    colons = F.regexp_replace(seconds, r"([+-]\d{2})(\d{2})$", "$1:$2")
    timed = F.regexp_like(text, F.lit(TIME))
    full = F.when(zoned, colons).when(timed, F.concat(seconds, F.lit("Z"))).otherwise(F.concat(text.try_cast("date").cast("string"), F.lit(" 00:00:00Z")))
    return F.when(F.regexp_like(text, F.lit(DATE)), utc(full.try_cast("timestamp")))


def cutoff(run_ts: str) -> Column:
    """Twelve hours before the run, a UTC time."""
    return instant(F.lit(run_ts)) - F.expr("interval 12 hours")


def next_earnings_date(raw: DataFrame, run_ts: str) -> DataFrame:
    """raw: symbol, ts string. The earliest date from 12 hours before the run on, in UTC; NULL if there is none."""
    at = instant(F.col("ts"))
    return raw.groupBy("symbol").agg(F.min(F.when(at >= cutoff(run_ts), at)).alias("next_earnings_date"))


def date_column(columns: list[str]) -> str:
    """The first column named date, datetime or index."""
    for c in columns:
        if c.strip().lower() in {"date", "datetime", "index"}:
            return c
    raise KeyError(f"no date column in {columns}")
