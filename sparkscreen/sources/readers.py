"""Sources: constituents from CSV, bars from a wide panel or a long table, live data behind a retried fetch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import date_column, normalize_symbol
from ..operators.joins import first_per_key
from ..operators.stored import stored

# Column names of the constituents file and of the relation made of it.
CONSTITUENT_NAMES = {
    "Symbol": "source_symbol", "Security": "company_name", "GICS Sector": "sector", "GICS Sub-Industry": "sub_industry",
    "Headquarters Location": "headquarters", "Date added": "date_added", "CIK": "CIK", "Founded": "founded",
}
#: Symbols that a task fetches at a time.
WORKERS = 4
#: Rows of bars that a task makes of a panel before it hands them on.
MELTED = 100_000
FIELDS = ("open", "high", "low", "close", "volume")


def in_file_order(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df, as just read from files, stored with the rows' numbers from 0: by path, place of the block in the file, place in it.

    Spark packs blocks into tasks by size, so ids that follow its tasks tell nothing about the files. Within a block, which
    one task reads from its start, they rise row by row: a row's number is the rows of the blocks before plus the id's
    distance from the block's first. The driver adds up a row a block, as it has listed the files.
    """
    block = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    t = stored(df.select("*", block.alias("__block"), F.monotonically_increasing_id().alias("__id")))
    blocks, ahead = [], 0
    for r in sorted(t.groupBy("__block").agg(F.min("__id"), F.count(F.lit(1))).collect()):
        blocks.append((r[0]["path"], r[0]["start"], r[1], ahead))
        ahead += r[2]
    firsts = df.sparkSession.createDataFrame(blocks, "path string, start bigint, first bigint, ahead bigint")
    found = t.join(F.broadcast(firsts.select(F.struct("path", "start").alias("__block"), "first", "ahead")), "__block")
    return found.select(*(F.col(c) for c in df.columns), (F.col("ahead") + F.col("__id") - F.col("first")).alias(name))


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header; columns that are not there are left out. ordinal is the order of the files' rows."""
    return constituents(in_file_order(spark.read.option("header", True).option("multiLine", True).csv(path)))


def constituents(raw: DataFrame) -> DataFrame:
    """Renamed columns and the normalized symbol; of rows that share a symbol the first by ordinal stays."""
    have = {k: v for k, v in CONSTITUENT_NAMES.items() if k in raw.columns}
    df = raw.select("ordinal", *(F.col(k).alias(v) for k, v in have.items()))
    df = df.select("ordinal", normalize_symbol(F.col("source_symbol")).alias("symbol"), *have.values())
    return first_per_key(df, "symbol", "ordinal")


def bars_from_panel(panel: DataFrame, fields: tuple[str, ...] = FIELDS, symbol: str | None = None) -> DataFrame:
    """A wide panel (a date column and columns ``SYMBOL|Field``) as long bars; rows without any value are dropped. A panel with
    columns ``Field`` only is that of the one given symbol. The plan does not grow with the symbols but by their columns' names:
    Arrow batches are taken apart in tasks, MELTED rows at a time."""
    day = date_column(panel.columns)
    symbols: dict[str, dict[str, str]] = {}
    clean = lambda field: field.strip().lower().replace(" ", "_")
    for c in panel.columns:
        if "|" in c:
            owner, field = c.split("|", 1)
            symbols.setdefault(owner, {})[clean(field)] = c
    if not symbols and symbol and (flat := {clean(c): c for c in panel.columns if clean(c) in fields}):
        symbols = {symbol: flat}
    if not symbols:
        raise RuntimeError("the price panel is empty")
    types = dict(panel.dtypes)
    used = [c for names in symbols.values() for f, c in names.items() if f in fields]
    at = {c: i for i, c in enumerate(used, 1)}  # columns go by their places: names may hold dots
    texts = [(F.col(f"`{c}`") if types[c] == "double" else F.col(f"`{c}`").try_cast("double")).alias(f"_{i}") for c, i in at.items()]
    dated = panel.select(F.col(f"`{day}`").cast("timestamp_ntz").alias("_0"), *texts)

    def melt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each symbol's columns as rows, some symbols at a time, without rows that have no value."""
        names = ["symbol", "price_date", *fields, "seq"]
        for batch in batches:
            days, missing, out, rows = batch.column(0), pa.nulls(len(batch), pa.float64()), [], 0
            for symbol, own in symbols.items():
                values = [batch.column(at[own[f]]) if f in own else missing for f in fields]
                some = reduce(pc.or_, (pc.fill_null(pc.invert(pc.is_nan(v)), False) for v in values))
                kept = pa.RecordBatch.from_arrays([pa.array([symbol] * len(batch)), days, *values, days], names=names).filter(some)
                out.append(kept)
                rows += len(kept)
                if rows >= MELTED:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, rows = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return dated.mapInArrow(melt, "symbol string, price_date timestamp_ntz, " + ", ".join(f"`{f}` double" for f in fields) + ", seq timestamp_ntz")


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars with a symbol, a date and a close."""
    return bars.na.drop("any", subset=["symbol", "price_date", "close"])


def symbol_history(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("symbol") == symbol)


def with_retry(fetch: Callable, *args, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str]:
    """(result, error text): waits longer after each failure and gives None when all attempts fail."""
    error = ""
    for attempt in range(1, attempts + 1):
        try:
            return fetch(*args), ""
        except Exception as e:  # noqa: BLE001 - any failure of a remote call is reported with the row
            error = f"{type(e).__name__}: {e}"
            if attempt < attempts:
                sleep(wait * attempt)
    return None, error


def fetch_analysts(symbols: DataFrame, calls: dict[str, Callable[[str], object]], schema: str, row: Callable[[str, dict[str, object]], dict]) -> DataFrame:
    """One row a symbol from remote calls made inside tasks, WORKERS symbols at a time in each; failures of a call go to
    data_errors as ``name=Type: text``. A symbol whose row can't be made has a row of NULLs and ``UNHANDLED=Type: text``.

    Write the result to a table and query that: a snapshot can be repeated, remote calls cannot.
    """

    columns = symbols.sparkSession.createDataFrame([], schema).columns

    def one(symbol: str) -> dict:
        try:
            got, errors = {}, []
            for name, call in calls.items():
                got[name], error = with_retry(call, symbol)
                if error:
                    errors.append(f"{name}={error}")
            return row(symbol, got) | {"symbol": symbol, "data_errors": " | ".join(errors)}
        except Exception as e:  # noqa: BLE001 - the symbol stays, with the reason
            return {"symbol": symbol, "data_errors": f"UNHANDLED={type(e).__name__}: {e}"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(WORKERS) as pool:
            for batch in batches:
                yield pd.DataFrame(list(pool.map(one, batch["symbol"])), columns=columns)

    return symbols.select("symbol").mapInPandas(run, schema)
