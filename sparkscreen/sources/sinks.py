"""Sinks: CSV folders, a snapshot that appears as a whole, and one workbook as an option."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import utc

# The tables that are exported as CSV, and their names there.
CSV_NAMES = {
    "constituents": "sp500_constituents", "price_metrics": "price_metrics", "analyst_data": "fresh_analyst_data", "all_stocks": "full_dual_score_analysis",
    "long_term_ranking": "long_term_ranking", "short_term_ranking": "short_term_entry_ranking", "combined_candidates": "combined_candidates", "insufficient_data": "insufficient_data",
}
# The sheets of the workbook, in order.
SHEETS = (
    "combined_candidates", "long_term_ranking", "short_term_ranking", "strong_candidates", "wait_for_entry", "tactical_candidates", "momentum_only",
    "insufficient_data", "all_stocks", "methodology", "run_metadata", "constituents",
)
MANIFEST = "run string, name string, path string"
#: Rows of a sheet of a workbook, which the driver writes.
SHEET_ROWS = 1_000_000


def without_zone(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock times, which spreadsheets take."""
    return df.withColumns({c: utc(F.col(c)) for c, kind in df.dtypes if kind == "timestamp"})


def export_csv(tables: dict[str, DataFrame], folder: str, history: DataFrame | None = None) -> None:
    """A CSV folder with a header for each table of CSV_NAMES; the price history is compressed. All keep their partitions."""
    for table, name in CSV_NAMES.items():
        if table in tables:
            tables[table].write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}.csv")
    if history is not None:
        history.drop("seq").write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(f"{folder}/daily_price_history.csv.gz")


def export_parquet(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def export_snapshot(tables: dict[str, DataFrame], folder: str, run_ts: str) -> str:
    """Writes the tables as Parquet into a folder of this run's own and, when all are there, a manifest that names them.

    Readers go by manifests alone, and Spark's commit makes a manifest's one file appear as a whole, so a run that dies
    half-way leaves what read_snapshot() finds as it was. Returns the run's id, which sorts by run_ts and then by time of writing.
    """
    run = f"{run_ts} {time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    own = f"{folder}/runs/{re.sub('[^0-9A-Za-z]+', '-', run)}"
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{own}/{name}")
        rows.append((run, name, f"{own}/{name}"))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    return run


def read_snapshot(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a run, by default of the newest that was written whole."""
    manifests = spark.read.schema(MANIFEST).parquet(f"{folder}/manifests")
    chosen = run or manifests.agg(F.max("run")).first()[0]
    return {r["name"]: spark.read.parquet(r["path"]) for r in manifests.where(F.col("run") == chosen).collect()}


def export_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One sheet for each of SHEETS that is there, written by the driver, which holds a partition of a table at a time; needs
    openpyxl, and tables of at most SHEET_ROWS rows."""
    import openpyxl

    book = openpyxl.Workbook(write_only=True)
    for name in SHEETS:
        if name not in tables:
            continue
        df = without_zone(tables[name])
        sheet = book.create_sheet(name)
        sheet.append(df.columns)
        for n, r in enumerate(df.toLocalIterator(), 1):
            if n > SHEET_ROWS:
                raise ValueError(f"{name} has more than {SHEET_ROWS} rows; export it as CSV or Parquet")
            sheet.append(list(r))
    book.save(path)
