from __future__ import annotations

import pytest
from compare import DATA, assert_same

import __spark_entry__ as entry
from sparkscreen.plans import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_has_a_row_a_company(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert {"symbol", "analyst_long_term_score", "short_term_entry_score", "risk_flags"} <= set(df.columns)


def test_bars_are_limited_before_the_first_shuffle(spark):
    from sparkscreen.operators import series
    from sparkscreen.sources import testdata

    plan = series.short_term_metrics(spark.read.parquet(f"{DATA}/lineitem.parquet").selectExpr("l_suppkey as symbol", "l_shipdate as price_date", "l_orderkey as seq", "l_tax as close", "l_quantity as volume"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    # from the top: numbers by symbol, the latest of each kind of close over all tasks, the same within each task, scan
    limits = [i for i, line in enumerate(text.splitlines()) if "WindowGroupLimit" in line]
    exchanges = [i for i, line in enumerate(text.splitlines()) if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and len(limits) == 2 and exchanges[1] < limits[1] and "Partial" in text.splitlines()[limits[1]] and "Window [" not in text[text.rindex("WindowGroupLimit") :]
    assert testdata.RUN_TS
