"""Payloads of analysts from a data source to one row a symbol, and instants in any session zone."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sparkscreen.functions import parse
from sparkscreen.operators import analysts as assembly
from sparkscreen.operators import features, joins
from sparkscreen.plans import queries, screen
from sparkscreen.sources import analysts, sinks, testdata

RUN_TS = "2001-12-01 00:00:00"
OPTIONS = {"provider": "tests.fakes:Broken", "wait": "0"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(found):
    rows = {r["symbol"]: r for r in found.collect()}
    assert sorted(rows) == ["A", "B", "C", "D", "E"]
    a, b, c, d, e = (rows[s] for s in "ABCDE")
    assert (a["latest_quote"], a["target_current"], a["target_low"], a["target_mean"], a["target_median"], a["target_high"]) == (2.0, 5.0, 3.0, None, 1.0, None)
    assert (a["strong_buy"], a["strong_sell"], a["buy"], a["recommendation_period"]) == (7.0, 2.0, None, "0M")
    assert (a["eps_up_7d"], a["eps_down_30d"], a["eps_revision_period"]) == (4.0, 1.5, " 0q")
    assert a["next_earnings_date"] == dt.datetime(2001, 12, 20) and a["data_errors"] == "" and a["data_fetched_at_utc"].year >= 2026
    assert (b["target_current"], b["data_errors"]) == (5.0, "")  # the second attempt
    assert (c["latest_quote"], c["target_current"], c["strong_buy"], c["data_errors"]) == (None, None, 7.0, "targets=TimeoutError: slow")
    assert d["data_errors"] == "UNHANDLED=RuntimeError: odd" and d["latest_quote"] is d["strong_buy"] is d["next_earnings_date"] is None and d["recommendation_period"] == ""
    assert (e["latest_quote"], e["target_current"], e["strong_buy"], e["eps_up_7d"], e["recommendation_period"], e["data_errors"]) == (10.0, None, None, None, "", "")


def test_data_source_keeps_symbols_that_fail(spark):
    raw = analysts.read_payloads(spark, batch="2", scale="2", **OPTIONS)
    assert raw.rdd.getNumPartitions() == 3
    assert {f.name: f.dataType for f in raw.schema} == {f.name: f.dataType for f in spark.createDataFrame([], analysts.PAYLOADS).schema}
    check(assembly.assemble(raw, "2001-12-02 12:00:00"))
    one = analysts.read_payloads(spark, symbols=" B, C ", **OPTIONS)
    assert {r["symbol"] for r in one.select("symbol").distinct().collect()} == {"B", "C"}
    assert analysts.read_payloads(spark, symbols="", **OPTIONS).count() == 0


def test_table_of_symbols(spark):
    symbols = spark.createDataFrame([(s,) for s in "ABCDE"], "symbol string").repartition(3)
    check(assembly.assemble(analysts.fetch_payloads(symbols, scale="2", **OPTIONS), "2001-12-02 12:00:00"))


def test_recorded_payloads_to_scores(spark, tmp_path):
    """Files, data source, one row a symbol, screen."""
    sources = screen.from_testdata(spark, "/root/testdata/sf0.001")
    for r in sources.constituents.limit(4).collect():
        whole = {"quote": {"last_price": 90}, "targets": {"median": 120, "high": 130, "low": 110}, "recommendations": [{"period": "0m", "strongBuy": 9, "buy": 3}], "eps_revisions": {"0q": {"up_last_30_days": 2}}, "earnings_dates": ["2002-01-05"]}
        if r["symbol"] == "S-2":
            del whole["targets"]
        (tmp_path / f"{r['symbol']}.json").write_text(json.dumps(whole))
    (tmp_path / "S-9.json").write_text("no json")
    raw = analysts.read_payloads(spark, provider="sparkscreen.sources.analysts:Recorded", folder=str(tmp_path), wait="0")
    rows = assembly.assemble(raw, testdata.RUN_TS)
    got = {r["symbol"]: r for r in rows.collect()}
    assert got["S-2"]["data_errors"] == "targets=KeyError: 'targets'" and got["S-9"]["data_errors"].count("JSONDecodeError") == 4
    scored = screen.Screen(sources.constituents, sources.bars, rows, queries.CONFIG, check=True).scored
    by = {r["symbol"]: r for r in scored.select("symbol", "current_price", "selected_target_price", "rating_count", "days_to_next_earnings").collect()}
    assert len(by) == 10 and by["S-1"]["current_price"] == 90 and by["S-1"]["selected_target_price"] == 120 and by["S-1"]["rating_count"] == 12 and by["S-1"]["days_to_next_earnings"] == 35
    assert by["S-2"]["selected_target_price"] is None and by["S-5"]["rating_count"] == 0


def test_assembly_is_one_aggregation(spark):
    plan = plan_of(queries.QUERIES["analyst_relation"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1 and "partial_min_by" in plan


def test_choices_by_key_plan_no_window(spark):
    hot = spark.range(1000).selectExpr("if(id % 10 < 9, 'HOT', cast(id as string)) as symbol", "id as ordinal", "if(id = 7, ' 0Q', '+1q') as index_label", "map('upLast7days', cast(id as string)) as kv")
    for df in (parse.pick_row(hot, "index_label", "0q"), joins.first_per_key(hot, "symbol", "ordinal")):
        assert "Window" not in plan_of(df) and "partial_min_by" in plan_of(df) and df.columns == hot.columns
    assert parse.pick_row(hot, "index_label", "0q").where("symbol = 'HOT'").first()["ordinal"] == 7
    assert joins.first_per_key(hot, "symbol", "ordinal").where("symbol = 'HOT'").first()["ordinal"] == 0
    odd = spark.createDataFrame([(None, None, "x"), (None, 3, "y"), ("A", None, "z")], "symbol string, ordinal int, v string")
    assert sorted((r["symbol"] or "", r["v"]) for r in joins.first_per_key(odd, "symbol", "ordinal").collect()) == [("", "x"), ("A", "z")]
    assert joins.first_per_key(odd.limit(0), "symbol", "ordinal").count() == 0


TIMES = {
    "2001-11-30T13:00:00Z": "2001-11-30 13:00", "2001-11-30 13:00:00": "2001-11-30 13:00", " 2001-11-30 ": "2001-11-30 00:00", "2001-11": "2001-11-01 00:00", "2001-11-30 13:00": "2001-11-30 13:00", "2001-11-30 13:00 UTC": "2001-11-30 13:00",
    "2001-11-30T13:00:00+0530": "2001-11-30 07:30", "2001-11-30 13:00:00-05:00": "2001-11-30 18:00", "2001-11-30 13:00:00 America/New_York": "2001-11-30 18:00", "2024-03-10 02:30:00": "2024-03-10 02:30",
    "12:00:00": None, "zz": None, "": None, None: None, "2001-13-01": None, "2001-02-30 01:00:00": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_instants_in_any_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = spark.createDataFrame([(t,) for t in TIMES], "t string")
        got = {r["t"]: r["at"] for r in texts.select("t", parse.instant(F.col("t")).alias("at")).collect()}
        assert {t: at and at.strftime("%Y-%m-%d %H:%M") for t, at in got.items()} == TIMES
        dates = spark.createDataFrame([("A", "2001-11-30T11:59:59Z"), ("A", "2001-11-30 12:00:00"), ("B", "2001-11-30T13:00:00Z"), ("C", "2001-11-30 11:00:00"), ("D", None)], "symbol string, ts string")
        found = parse.next_earnings_date(dates, RUN_TS)
        assert dict(found.dtypes)["next_earnings_date"] == "timestamp_ntz"
        assert {r["symbol"]: r["next_earnings_date"] for r in found.collect()} == {"A": dt.datetime(2001, 11, 30, 12), "B": dt.datetime(2001, 11, 30, 13), "C": None, "D": None}
        moment = spark.sql("select timestamp_micros(1710054000000000) as t")  # 2024-03-10T07:00Z, when New York's clocks change
        assert sinks.without_zone(moment).first()["t"] == dt.datetime(2024, 3, 10, 7)
        company = spark.sql("select 1 as ordinal, 'A' as symbol")
        price = spark.sql("select 'A' as symbol, 1d as history_price")
        numbers = ", ".join(f"1d as {c}" for c in features.NUMBERS)
        for kind in ("timestamp_micros(1007251200000000)", "timestamp_ntz'2001-12-02 00:00:00'"):
            known = spark.sql(f"select 'A' as symbol, {numbers}, {kind} as next_earnings_date")
            row = features.build_analysis(company, price, known, screen.ScreenConfig(run_ts=RUN_TS)).first()
            assert row["days_to_next_earnings"] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
