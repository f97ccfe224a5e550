from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkscreen.config import ScreenConfig, read_dotenv
from sparkscreen.functions import parse
from sparkscreen.operators import joins, report, series
from sparkscreen.plans import screen
from sparkscreen.sources import readers, sinks, testdata

COUNTS = (0, 1, 5, 6, 19, 20, 21, 49, 50, 199, 200, 252, 253, 260)


def bars_frame(seed=1):
    rng, rows = np.random.default_rng(seed), []
    for n in COUNTS:
        for i in range(n):
            close = None if i % 13 == 4 and n > 21 else float(100 + rng.normal() * 5)
            rows.append((f"N{n}", dt.datetime(2000, 1, 1) + dt.timedelta(days=i), i, close, None if i % 7 == 2 else float(rng.integers(1, 1000))))
    return rows + [("NULLS", dt.datetime(2000, 1, 1), 0, None, 5.0)]


def test_series_equal_pandas(spark):
    rows = bars_frame()
    bars = spark.createDataFrame(rows, "symbol string, price_date timestamp_ntz, seq int, close double, volume double")
    symbols = spark.createDataFrame([(f"N{n}",) for n in COUNTS] + [("NULLS",)], "symbol string")
    prices = series.price_metrics(symbols, bars).toPandas().set_index("symbol")
    short = series.short_term_metrics(bars).toPandas().set_index("symbol")
    data = pd.DataFrame(rows, columns=["symbol", "d", "seq", "close", "volume"])
    assert prices.loc["N0", "history_error"] == "NO_PRICE_HISTORY" and prices.loc["NULLS", "history_error"] == "NO_VALID_CLOSE"
    assert "N0" not in short.index and "NULLS" not in short.index
    for n in COUNTS[1:]:
        g = data[data.symbol == f"N{n}"].sort_values("seq")
        c, v, p, s = g.close.dropna(), g.volume, prices.loc[f"N{n}"], short.loc[f"N{n}"]
        r = c.pct_change().dropna()
        near = lambda a, b: (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b)
        assert near(p.history_price, c.iloc[-1])
        for k in (20, 50, 200):
            assert near(p[f"ma_{k}"], c.tail(k).mean() if len(c) >= k else np.nan)
        assert near(p.volatility_annual_pct, r.tail(252).std() * 252**0.5 * 100 if len(r) >= 20 else np.nan)
        assert near(p.average_volume_20d, v.tail(20).mean() if v.notna().any() else np.nan)
        for k in (1, 2, 5, 20):
            assert near(s[f"return_{k}d_pct"], (c.iloc[-1] / c.iloc[-k - 1] - 1) * 100 if len(c) > k else np.nan)
        assert near(s.negative_days_last_5, (r.tail(5) < 0).sum() if len(r) >= 5 else np.nan)
        assert near(s.worst_daily_return_5d_pct, r.tail(5).min() * 100 if len(r) >= 5 else np.nan)


def test_long_histories_equal_a_series_of_all_bars(spark):
    """One symbol with nine of ten rows, runs of zero and missing closes at either end: as pandas has it from all rows."""
    rng, rows = np.random.default_rng(3), []
    shapes = {"HOT": (9000, lambda i, n: rng.random() * 50), "ZEROS": (700, lambda i, n: 0.0 if i >= n - 300 else 5.0 + i), "FEW": (600, lambda i, n: 0.0 if i > 18 else 1.0 + i), "GAPS": (800, lambda i, n: None if i >= n - 260 or i % 3 else 10.0 + i % 7), "LAST": (400, lambda i, n: None if i else 3.0)}
    for name, (n, close) in shapes.items():
        rows += [(name, i, close(i, n), None if i % 5 == 0 else float(i)) for i in range(n)]
    rng.shuffle(rows)
    bars = spark.createDataFrame([(str(a), int(i), None if c is None else float(c), None if v is None else float(v)) for a, i, c, v in rows], "symbol string, i int, close double, volume double")
    bars = bars.selectExpr("symbol", "timestampadd(DAY, i, timestamp_ntz'1990-01-01 00:00:00') as price_date", "struct(i, symbol) as seq", "close", "volume").repartition(6)
    got = series.all_metrics(bars.select("symbol").distinct(), bars).toPandas().set_index("symbol")
    data = pd.DataFrame(rows, columns=["symbol", "i", "close", "volume"])
    for name in shapes:
        g = data[data.symbol == name].sort_values("i")
        c = g.close.astype(float).dropna()
        r = (c / c.shift().replace(0, np.nan) - 1).dropna()  # the return after a close of 0 is missing
        last = c.pct_change().where(c.shift() != 0).iloc[1:].tail(252)
        p = got.loc[name]
        near = lambda a, b: (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b)
        assert near(p.history_price, c.iloc[-1]) and near(p.average_volume_20d, g.volume.astype(float).tail(20).mean())
        assert near(p.ma_200, c.tail(200).mean() if len(c) >= 200 else np.nan)
        assert near(p.volatility_annual_pct, last.dropna().std() * 252**0.5 * 100 if len(r) >= 20 else np.nan), name
        assert near(p.return_20d_pct, (c.iloc[-1] / c.iloc[-21] - 1) * 100 if len(c) > 20 and c.iloc[-21] else np.nan)
    assert series.recent(bars).where("symbol = 'HOT'").count() == series.LOOK_BACK


def test_join_rejects_repeated_keys(spark):
    one, two = spark.createDataFrame([("a",)], "symbol string"), spark.createDataFrame([("a", 1), ("a", 2)], "symbol string, x int")
    with pytest.raises(ValueError, match="isn't unique"):
        joins.left_join_one_to_one(one, two)


def test_parsers(spark):
    raw = spark.createDataFrame([("A", {"Current Price": "5", "low": "x", "low_price": "3"})], "symbol string, kv map<string,string>")
    assert parse.parse_targets(raw).first().asDict() == {"symbol": "A", "target_current": None, "target_low": None, "target_mean": None, "target_median": None, "target_high": None}
    dates = spark.createDataFrame([("A", "2001-12-01 03:00:00"), ("A", "2001-11-30 11:00:00"), ("A", "2001-11-30 13:00:00"), ("B", "zz"), ("B", None)], "symbol string, ts string")
    got = {r["symbol"]: r["next_earnings_date"] for r in parse.next_earnings_date(dates, "2001-12-01 00:00:00").collect()}
    assert got["B"] is None and got["A"].hour == 13
    assert parse.date_column(["x", "Date"]) == "Date"
    with pytest.raises(KeyError):
        parse.date_column(["x"])


def test_panel_to_bars(spark):
    panel = spark.createDataFrame([("2001-01-01", 1.0, None, 2.0), ("2001-01-02", None, None, 3.0)], "Date string, `A|Close` double, `A|Volume` double, `B|Close` double")
    got = {(r["symbol"], r["close"]) for r in readers.bars_from_panel(panel).collect()}
    assert got == {("A", 1.0), ("B", 2.0), ("B", 3.0)}
    flat = spark.createDataFrame([("2001-01-01", 1.0, 5.0), ("2001-01-02", None, None)], "Date string, Close double, Volume double")
    assert [(r["symbol"], r["close"], r["volume"]) for r in readers.bars_from_panel(flat, symbol="Z").collect()] == [("Z", 1.0, 5.0)]
    assert readers.clean_bars(readers.bars_from_panel(panel)).where("symbol = 'A'").count() == 1
    assert readers.symbol_history(readers.bars_from_panel(panel), "B").count() == 2
    for empty in (flat.select("Date"), flat):
        with pytest.raises(RuntimeError, match="empty"):
            readers.bars_from_panel(empty)


def test_constituents_from_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Symbol,Security,GICS Sector,CIK,Other\nBRK.B,"Berk, Inc",Fin,12,x\n BRK-B ,Second,Fin,13,y\nAAA,Three,,,z\n')
    got = readers.read_constituents(spark, str(tmp_path / "c.csv")).orderBy("ordinal").collect()
    assert [(r["symbol"], r["source_symbol"], r["company_name"], r["sector"], r["CIK"]) for r in got] == [("BRK-B", "BRK.B", "Berk, Inc", "Fin", "12"), ("AAA", "AAA", "Three", None, None)]


def test_parallel_fetch_keeps_symbols_that_fail(spark):
    def quote(symbol):
        if symbol == "B":
            raise TimeoutError("slow")
        return 2.0

    def row(symbol, got):
        return {"latest_quote": got["quote"] * 2}  # fails where there is none

    got = {r["symbol"]: (r["latest_quote"], r["data_errors"]) for r in readers.fetch_analysts(spark.createDataFrame([(s,) for s in "ABC"], "symbol string"), {"quote": quote}, "symbol string, latest_quote double, data_errors string", row).collect()}
    assert got["A"] == (4.0, "") and got["C"] == (4.0, "")
    assert got["B"][0] is None and got["B"][1].startswith("UNHANDLED=TypeError")


def test_retry_and_config():
    waits, calls = [], []

    def fails(x):
        calls.append(x)
        raise TimeoutError("slow")

    assert readers.with_retry(fails, "A", sleep=waits.append) == (None, "TimeoutError: slow")
    assert waits == [2.0, 4.0] and calls == ["A"] * 3
    assert read_dotenv("# c\nA=1\nB='2'\n", {"A": "0"}) == {"A": "0", "B": "2"}
    assert ScreenConfig.from_env({"EXPORT_RESULTS": "Yes", "LOW_AVERAGE_DOLLAR_VOLUME": "5"}, run_ts="x") == ScreenConfig(export=True, low_dollar_volume=5.0, run_ts="x")
    assert ScreenConfig().run_ts > "2026"


def test_run_validates_and_exports(spark, tmp_path):
    s = screen.from_testdata(spark, "/root/testdata/sf0.001")
    config = ScreenConfig(export=True, run_ts=testdata.RUN_TS, ticker="S.4", top_n=3)
    done = screen.run(s.constituents, s.bars, s.analysts, config, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "full_dual_score_analysis.csv")).count() == 10
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["combined_candidates.csv", "daily_price_history.csv.gz", "fresh_analyst_data.csv", "full_dual_score_analysis.csv", "insufficient_data.csv", "long_term_ranking.csv", "price_metrics.csv", "short_term_entry_ranking.csv", "sp500_constituents.csv"]
    printed = done.printed()
    assert printed["long_term"].count() <= 3 and printed["detail"].where("field = 'symbol'").first()["value"] == "S-4"
    report.validate(done.scored)
    assert report.ticker_detail(done.scored, "s.3").where(F.col("field") == "symbol").first()["value"] == "S-3"
    assert sinks.without_zone(spark.range(1).select(F.current_timestamp().alias("t"))).dtypes == [("t", "timestamp_ntz")]
