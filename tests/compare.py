"""Holds a query's rows against DuckDB's for its SQL, whatever their order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda v: "~" if v is None or pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in df.astype(object).itertuples(index=False))


def assert_same(spark, query, sql: str, folder: str = DATA) -> None:
    found, want = query(spark, folder).toPandas(), connection(folder).sql(sql).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)
