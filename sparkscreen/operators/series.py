"""Price features: per symbol over trailing rows of its bars.

bars: symbol, price_date, seq (a total order within the symbol, of any type that can be ordered), close, volume. No feature looks
further back than LOOK_BACK closes, so tasks keep only their latest bars of each symbol before anything is shuffled; the
features then come from one window over (symbol, seq descending) and one aggregation on symbol. Moving averages and returns
count rows with a close; volume counts all rows. Symbols without bars are missing here and stay NULL in later left joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import finite, pct_over

#: Closes that the longest feature needs: 252 returns.
LOOK_BACK = 253
LATEST = "over (partition by symbol order by seq desc"


def recent(bars: DataFrame) -> DataFrame:
    """The latest LOOK_BACK bars of each symbol with no close, with a close of 0, and with another close; numbers made finite.

    These three hold a symbol's latest LOOK_BACK bars, its latest LOOK_BACK closes, and as many closes that a return can be
    reckoned from. Spark applies the limit in each task before the shuffle and again after it, so a symbol sends a bounded
    number of rows a task, however long its history is and however many of all rows it has.
    """
    clean = bars.select("symbol", "price_date", "seq", finite(F.col("close")).alias("close"), finite(F.col("volume")).alias("volume"))
    kind = F.when(F.col("close").isNull(), 0).when(F.col("close") == 0, 1).otherwise(2)
    latest = W.partitionBy("symbol", kind).orderBy(F.col("seq").desc())
    return clean.withColumn("__k", F.row_number().over(latest)).where(F.col("__k") <= LOOK_BACK).drop("__k")


def numbered(bars: DataFrame) -> DataFrame:
    """Adds ra (all rows from the latest), rn (rows with a close), ret (return over the close before) to recent bars."""
    return recent(bars).select(
        "*",
        F.expr(f"row_number() {LATEST})").alias("ra"),
        F.expr(f"case when close is not null then count(close) {LATEST} rows between unbounded preceding and current row) end").alias("rn"),
        F.expr(f"case when close is not null then try_divide(close, lead(close, 1) ignore nulls {LATEST})) - 1 end").alias("ret"),
    )


def _mean(k: int) -> Column:
    return F.when(F.count("close") >= k, F.avg(F.when(F.col("rn") <= k, F.col("close"))))


def _at(k: int) -> Column:
    return F.max(F.when(F.col("rn") == k, F.col("close")))


def _returns() -> Column:
    """Returns of the whole history, as far as any feature asks: closes, but the latest, that are not 0."""
    return F.count(F.when((F.col("rn") > 1) & (F.col("close") != 0), 1))


def _std(k: int, least: int) -> Column:
    return F.when(_returns() >= least, F.stddev_samp(F.when(F.col("rn") <= k, F.col("ret"))) * F.sqrt(F.lit(252.0)) * 100)


def aggregated(bars: DataFrame) -> DataFrame:
    """A row a symbol with bars: all that price and short-term features need, of which a query computes what it uses."""
    r = _returns()
    return numbered(bars).groupBy("symbol").agg(
        F.count("close").alias("n"),
        _at(1).alias("last"),
        *(_at(k + 1).alias(f"c{k}") for k in (1, 2, 5, 20)),
        F.max(F.when(F.col("rn") == 1, F.col("price_date"))).alias("price_as_of"),
        *(_mean(k).alias(f"ma_{k}") for k in (20, 50, 200)),
        _std(252, 20).alias("volatility_annual_pct"),
        _std(20, 20).alias("short_volatility_20d_pct"),
        F.when(F.count("volume") > 0, F.avg(F.when(F.col("ra") <= 20, F.col("volume")))).alias("volume_20"),
        F.when(F.count("close") >= 20, F.max(F.when(F.col("rn") <= 20, F.col("close")))).alias("high_20"),
        F.when(r >= 5, F.count(F.when((F.col("rn") <= 5) & (F.col("ret") < 0), 1))).cast("double").alias("negative_days_last_5"),
        (F.when(r >= 5, F.min(F.when(F.col("rn") <= 5, F.col("ret")))) * 100).alias("worst_daily_return_5d_pct"),
    )


def price_columns() -> list[Column]:
    last, volume = F.col("last"), F.col("volume_20")
    return [
        last.alias("history_price"),
        F.col("price_as_of"),
        *(F.col(f"ma_{k}") for k in (20, 50, 200)),
        pct_over(last, F.col("ma_200")).alias("price_vs_200d_ma_pct"),
        F.col("volatility_annual_pct"),
        F.when(last.isNotNull(), volume).alias("average_volume_20d"),
        (last * volume).alias("average_dollar_volume_20d"),
        F.when(F.col("n").isNull(), "NO_PRICE_HISTORY").when(last.isNull(), "NO_VALID_CLOSE").otherwise("").alias("history_error"),
    ]


def short_columns() -> list[Column]:
    last, ma_20, ma_50 = F.col("last"), F.col("ma_20"), F.col("ma_50")
    return [
        last.alias("short_price"),
        *(pct_over(last, F.col(f"c{k}")).alias(f"return_{k}d_pct") for k in (1, 2, 5, 20)),
        ma_20.alias("short_ma_20"),
        ma_50.alias("short_ma_50"),
        pct_over(last, ma_20).alias("distance_from_ma20_pct"),
        pct_over(last, ma_50).alias("distance_from_ma50_pct"),
        pct_over(last, F.col("high_20")).alias("drawdown_from_20d_high_pct"),
        F.col("short_volatility_20d_pct"),
        F.col("short_volatility_20d_pct").alias("volatility_20d_annualized_pct"),
        F.col("negative_days_last_5"),
        F.col("worst_daily_return_5d_pct"),
    ]


def price_metrics(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """A row a symbol: last price, moving averages, annual volatility, volume, and why there is no history."""
    return symbols.select("symbol").join(aggregated(bars), "symbol", "left").select("symbol", *price_columns())


def short_term_metrics(bars: DataFrame) -> DataFrame:
    """A row a symbol with a close: returns over 1, 2, 5, 20 rows, distances, drawdown, recent volatility and losses."""
    return aggregated(bars).where(F.col("last").isNotNull()).select("symbol", *short_columns())


def all_metrics(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """price_metrics and the columns of short_term_metrics from one aggregation; the latter are NULL without a close."""
    return symbols.select("symbol").join(aggregated(bars), "symbol", "left").select("symbol", *price_columns(), *short_columns())
