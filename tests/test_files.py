"""File-exact ordinals, wide panels, snapshots, the workbook, and numbers as they are shown."""

from __future__ import annotations

import datetime as dt
import sys
import types

import pytest
from pyspark.sql import functions as F

from sparkscreen.config import ScreenConfig
from sparkscreen.operators import report
from sparkscreen.plans import screen
from sparkscreen.sources import readers, sinks, testdata


def test_ordinals_follow_the_files(spark, tmp_path):
    """Spark reads the largest block first; the files' own order decides which of two rows with one symbol stays."""
    sizes = {"a.csv": 3, "b.csv": 4000, "c.csv": 50, "d.csv": 0}
    want = []
    for name, n in sizes.items():
        lines = [f'X.{i % 40},"{name} {i}\nsecond line",S' for i in range(n)]
        (tmp_path / name).write_text("Symbol,Security,GICS Sector\n" + "\n".join(lines) + "\n" * bool(n))
        want += [f"{name} {i}\nsecond line" for i in range(n)]
    raw = spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path))
    got = readers.in_file_order(raw).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == [*range(len(want))] and [r["Security"] for r in got] == want
    kept = {r["symbol"]: r["company_name"] for r in readers.read_constituents(spark, str(tmp_path)).collect()}
    assert len(kept) == 40 and kept["X-0"].startswith("a.csv 0") and kept["X-3"].startswith("b.csv 3\n")


def test_ordinals_of_split_files(spark, tmp_path):
    spark.range(30_000).selectExpr("id as Symbol").coalesce(1).write.option("header", True).csv(str(tmp_path / "one"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = readers.in_file_order(spark.read.option("header", True).csv(str(tmp_path / "one")))
        assert got.select("Symbol").rdd.getNumPartitions() >= 1 and got.where("ordinal <> cast(Symbol as bigint)").count() == 0 and got.count() == 30_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_wide_panel(spark, monkeypatch):
    """3,000 columns; the plan names no symbol and has no expression for one."""
    monkeypatch.setattr(readers, "MELTED", 500)
    days, symbols = 4, 600
    names = [f"S{i}.X|{f}" for i in range(symbols) for f in ("Open", "High", "Low", "Close", "Volume")]
    rows = [(f"2001-01-0{d + 1}", *(None if i % 7 == d else float("nan") if i % 11 == 3 and k < 4 else float(i * 10 + k) for i in range(symbols) for k in range(5))) for d in range(days)]
    panel = spark.createDataFrame(rows, ", ".join(["Date string", *(f"`{n}` double" for n in names)])).repartition(2)
    bars = readers.bars_from_panel(panel)
    plan = bars._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("struct(") == 0 and "explode" not in plan.toString()
    got = {(r["symbol"], r["price_date"]): r for r in bars.collect()}
    assert len(got) == sum(i % 7 != d for i in range(symbols) for d in range(days))
    r = got["S5.X", dt.datetime(2001, 1, 2)]
    assert (r["open"], r["close"], r["volume"], r["seq"]) == (50.0, 53.0, 54.0, r["price_date"])
    assert got["S14.X", dt.datetime(2001, 1, 2)]["volume"] == 144.0 and got["S14.X", dt.datetime(2001, 1, 2)]["open"] != got["S14.X", dt.datetime(2001, 1, 2)]["open"]
    text = spark.createDataFrame([("2001-01-01", " 7 ", "x"), ("2001-01-02", None, None), (None, "1e3", "2")], "index string, `A B|Close` string, `A B|Adj Close` string")
    got = readers.bars_from_panel(text).collect()
    assert sorted((str(r["price_date"]), r["symbol"], r["close"]) for r in got) == [("2001-01-01 00:00:00", "A B", 7.0), ("None", "A B", 1000.0)]


def test_a_run_that_dies_leaves_the_old_snapshot(spark, tmp_path):
    folder = str(tmp_path / "snap")
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("y")
    first = sinks.export_snapshot({"one": one, "two": two}, folder, "2001-12-01 00:00:00")
    broken = two.select(F.raise_error(F.concat(F.lit("at "), F.col("y").cast("string"))).alias("y"))
    with pytest.raises(Exception, match="at "):
        sinks.export_snapshot({"one": one.limit(1), "two": broken}, folder, "2001-12-02 00:00:00")
    found = sinks.read_snapshot(spark, folder)
    assert {k: v.count() for k, v in found.items()} == {"one": 3, "two": 5}
    sinks.export_snapshot({"one": one.limit(1)}, folder, "2001-12-02 00:00:00")
    assert {k: v.count() for k, v in sinks.read_snapshot(spark, folder).items()} == {"one": 1}
    assert {k: v.count() for k, v in sinks.read_snapshot(spark, folder, first).items()} == {"one": 3, "two": 5}


@pytest.fixture
def book(monkeypatch):
    """Stands for openpyxl where it is not installed: keeps what is appended to each sheet."""
    made = {}

    class Workbook:
        def __init__(self, write_only):
            self.sheets = {}

        def create_sheet(self, name):
            self.sheets[name] = []
            return self.sheets[name]

        def save(self, path):
            made[path] = self.sheets

    module = types.ModuleType("openpyxl")
    module.__spec__, module.Workbook = types.SimpleNamespace(), Workbook
    monkeypatch.setitem(sys.modules, "openpyxl", module)
    return made


def test_workbook_and_snapshot_of_a_run(spark, tmp_path, book):
    s = screen.from_testdata(spark, "/root/testdata/sf0.001")
    config = ScreenConfig(export=True, run_ts=testdata.RUN_TS)
    screen.run(s.constituents, s.bars, s.analysts, config, snapshot=str(tmp_path / "snapshot"), workbook=str(tmp_path / "book.xlsx"))
    sheets = book[str(tmp_path / "book.xlsx")]
    assert tuple(sheets) == sinks.SHEETS and len(sheets["all_stocks"]) == 11 and len(sheets["methodology"]) == 12
    header = sheets["all_stocks"][0]
    assert {r[header.index("symbol")] for r in sheets["all_stocks"][1:]} == {r["symbol"] for r in s.constituents.collect()}
    snapshot = sinks.read_snapshot(spark, str(tmp_path / "snapshot"))
    assert set(snapshot) >= set(sinks.SHEETS) and snapshot["all_stocks"].count() == 10


def test_workbook_of_too_many_rows(spark, tmp_path, book, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 4)
    sinks.export_workbook({"constituents": spark.range(4)}, "fits")
    with pytest.raises(ValueError, match="more than 4 rows"):
        sinks.export_workbook({"constituents": spark.range(5)}, "not")
    assert [*book] == ["fits"]


def test_numbers_as_they_are_shown(spark):
    df = spark.createDataFrame([("A", 1234567.891, None, None, 3, ""), ("B", 0.0, 1.0, 2.0, None, "x")], "symbol string, current_price double, positive_rating_pct double, rating_count double, long_term_rank int, risk_flags string")
    assert {r["field"]: r["value"] for r in report.ticker_display(df, " a ").collect()} == {"symbol": "A", "long_term_rank": "3/2", "current_price": "1,234,567.89", "positive_rating_pct": "N/A", "rating_count": "N/A", "risk_flags": "None"}
    assert {r["field"]: r["value"] for r in report.ticker_display(df, "b").collect()} == {"symbol": "B", "long_term_rank": "N/A/2", "current_price": "0.00", "positive_rating_pct": "1.00%", "rating_count": "2.00", "risk_flags": "x"}
    assert report.ticker_display(df, "none").count() == 0
