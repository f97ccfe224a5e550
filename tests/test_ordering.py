"""Row numbers, ranks and percentiles of all rows against pandas, and the plans and tasks that make them."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkscreen.operators import ordering, rank, report
from sparkscreen.plans import queries, screen

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Else these small tables would be one partition each."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(n=3000, seed=4):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), 7.0, 7.0, 7.0, -0.0, 0.0, float(rng.randrange(50)), rng.random()])
    return [(i, "HOT" if rng.random() < 0.95 else rng.choice([None, "B", "C"]), value(), rng.random() < 0.7) for i in range(n)] + [(n, "FEW", 1.0, True), (n + 1, "FEW", None, False)]


SCHEMA = "id bigint, g string, v double, able boolean"


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_and_percentiles_equal_pandas(spark, parts):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    frame = pd.DataFrame(data, columns=["id", "g", "v", "able"], dtype=object).set_index("id").astype({"able": bool})
    key = frame.v.map(lambda v: -float("inf") if v is None else float("inf") if v != v else v + 0.0).astype(float)  # Spark's order: NaN is the largest
    got = ordering.min_ranks(df, {"r": ("v", F.col("able")), "s": ("v", F.lit(True))}).toPandas().set_index("id").sort_index()
    assert len(got) == len(data)
    able = key[frame.able].rank(method="min", ascending=False).reindex(key.index)
    assert got.r.isna().equals(able.isna()) and got.r.dropna().astype(float).equals(able.dropna()) and got.s.astype(float).equals(key.rank(method="min", ascending=False))
    got = ordering.percentile_in_group(df, "v", "g", "p").toPandas().set_index("id").sort_index()
    have = frame.g.notna() & frame.v.map(lambda v: v is not None)
    want = key[have].groupby(frame.g[have]).rank(method="average") / key[have].groupby(frame.g[have]).transform("count") * 100
    want[frame.g[have] == "FEW"] = None
    assert len(got) == len(data)
    pd.testing.assert_series_equal(got.p, want.reindex(key.index), check_names=False, check_index_type=False)


def test_numbers_equal_a_sort(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = ordering.numbered(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], "n").orderBy("n").collect()
    want = sorted(data, key=lambda r: (r[2] is None, 0 if r[2] is None else -float("inf") if r[2] != r[2] else -r[2], r[0]))
    assert [r["n"] for r in got] == [*range(1, len(data) + 1)] and [r["id"] for r in got] == [r[0] for r in want]


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ordering.numbered(none, [F.col("v").asc()], "n").count() == 0
    assert ordering.min_ranks(none, {"r": ("v", F.lit(True))}).columns == ["id", "g", "v", "able", "r"]
    assert ordering.percentile_in_group(none, "v", "g", "p").count() == 0
    same = spark.createDataFrame([(1, "A", 2.0, True)] * 6 + [(1, "A", 1.0, False)] * 2, SCHEMA)
    got = ordering.percentile_in_group(ordering.min_ranks(same, {"r": ("v", F.col("able"))}), "v", "g", "p")
    assert sorted((r["v"], r["r"] or 0, r["p"]) for r in got.collect()) == [(1.0, 0, 1.5 / 8 * 100)] * 2 + [(2.0, 1, 5.5 / 8 * 100)] * 6
    assert sorted(r["n"] for r in ordering.numbered(same, [F.col("v").asc()], "n").collect()) == [*range(1, 9)]


def test_one_large_group_is_spread(spark):
    """95 of 100 rows in one group: its values are dealt over the range partitions, and no task holds them all."""
    df = spark.range(20_000).selectExpr("if(id % 20 > 0, 'HOT', 'COLD') as g", "cast(id * 7919 % 20000 as double) as v")
    t = ordering.in_order(df.groupBy("g", "v").agg(F.count("*").alias("ties")), [F.col("g").asc(), F.col("v").asc()])
    sizes = [r["count"] for r in t.where("g = 'HOT'").groupBy("__part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * 19_000 / len(sizes)
    got = ordering.percentile_in_group(df, "v", "g", "p")
    assert got.agg(F.max("p"), F.count("p")).first() == (100.0, 20_000)


def windows_of(df):
    return [line for line in plan_of(df).splitlines() if "Window " in line or "WindowExec" in line]


def test_no_window_holds_all_rows(spark):
    x = screen.from_testdata(spark, DATA)
    for df in (x.scored, rank.combined_candidates(x.scored), queries.QUERIES["line_numbers"](spark, DATA), queries.QUERIES["line_ranks"](spark, DATA), report.validation_counts(x.scored)):
        assert all("__part" in w for w in windows_of(df)) and "SinglePartition, ENSURE" not in plan_of(df.select("*")).replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "", 1 if df.columns[0] == "invariant" else 0)


def test_reports_do_not_plan_the_screen_again(spark):
    x = screen.from_testdata(spark, DATA)
    for df in (report.validation_counts(x.scored), report.run_metadata(x.constituents, x.store_analysts(), x.scored, queries.CONFIG)):
        assert "lineitem" not in plan_of(df)


def test_rows_are_not_shuffled_by_a_few_values_nor_joined_before_they_are_counted(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    counted = []
    of = ordering.value_places
    monkeypatch.setattr(ordering, "value_places", lambda df, *a, **k: counted.append(plan_of(df)) or of(df, *a, **k))
    try:
        plan = plan_of(queries.QUERIES["line_ranks"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = [line for line in plan.splitlines() if "Join [" in line]
    assert len(counted) == 2 and not any("Join" in p or "Generate" in p for p in counted)
    assert len(joined) >= 3 and all("BroadcastHashJoin" in line for line in joined)


def test_many_values_are_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SENT_VALUES", 10)
    test_ranks_and_percentiles_equal_pandas(spark, 7)


def test_analysts_read_the_latest_bars_alone(spark):
    from sparkscreen.sources import testdata

    got, want = testdata.analysts(spark, DATA), testdata.load(spark, DATA, testdata.ANALYSTS)
    assert "WindowGroupLimit" in plan_of(got) and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
