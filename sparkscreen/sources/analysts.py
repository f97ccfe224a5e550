"""Raw analyst payloads of symbols, one long relation: a batch data source over a provider, or a fetch for a table of symbols.

A provider is a class with the methods quote, targets, recommendations, eps_revisions and earnings_dates, each of which takes a
symbol and returns what PROVIDER_SHAPES says, or raises. Providers are named ``module:Class`` and made in each task from the
options, so that nothing but names and strings travels. Recorded reads payloads that were stored as JSON files.

Rows (PAYLOADS): call names the method, ordinal is the place in a list, label the period or index label, kv the fields, text
a date. A call that fails after its retries is a row with an error; the quote is not retried and has no error. Whatever else
goes wrong with a symbol is a row of the call ``unhandled``. Each symbol has a row of the call ``quote``, or that one.
operators.analysts.assemble() makes one row a symbol of them. Write the relation to a table before it is used: a snapshot
can be read again, remote calls cannot.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, date, datetime
from importlib import import_module
from pathlib import Path
from urllib.parse import quote as as_file_name

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import WORKERS, with_retry

PAYLOADS = "symbol string, call string, ordinal bigint, label string, kv map<string,string>, text string, error string, fetched_at timestamp_ntz"
ARROW = pa.schema(
    [("symbol", pa.string()), ("call", pa.string()), ("ordinal", pa.int64()), ("label", pa.string()), ("kv", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("error", pa.string()), ("fetched_at", pa.timestamp("us"))]
)
PROVIDER_SHAPES = {
    "quote": "fields of a quote",
    "targets": "fields of the price targets",
    "recommendations": "a list of fields, one of which may be a period",
    "eps_revisions": "index labels with the fields of each",
    "earnings_dates": "a list of dates, as texts or as date objects",
}
#: Calls that are retried, in the order in which their errors are listed.
RETRIED = ("targets", "recommendations", "eps_revisions", "earnings_dates")
#: Symbols of a partition of the data source.
BATCH = 64


class Recorded:
    """Payloads stored as ``<folder>/<symbol>.json``, each with the names of PROVIDER_SHAPES; a missing name fails that call."""

    def __init__(self, options: dict[str, str]):
        self.folder = Path(options["folder"])

    def symbols(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def _get(self, symbol: str, name: str) -> object:
        return json.loads((self.folder / f"{as_file_name(symbol, safe='')}.json").read_text())[name]

    def quote(self, symbol: str) -> object:
        return self._get(symbol, "quote")

    def targets(self, symbol: str) -> object:
        return self._get(symbol, "targets")

    def recommendations(self, symbol: str) -> object:
        return self._get(symbol, "recommendations")

    def eps_revisions(self, symbol: str) -> object:
        return self._get(symbol, "eps_revisions")

    def earnings_dates(self, symbol: str) -> object:
        return self._get(symbol, "earnings_dates")


def make_provider(name: str, options: dict[str, str]) -> object:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)(options)


def written(value: object) -> str | None:
    """A field as text; numbers as Python writes floats, nothing and NaN as NULL."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return str(float(value)) if isinstance(value, (bool, int, float)) else str(value)


def fields(value: object) -> list[tuple[str, str | None]] | None:
    return [(str(k), written(v)) for k, v in value.items()] if isinstance(value, dict) else None


def symbol_rows(symbol: str, provider: object, options: dict[str, str]) -> list[dict]:
    """The rows of one symbol; a payload of another shape than that of its call counts as none."""
    now = datetime.now(UTC).replace(tzinfo=None)
    row = lambda call, ordinal=0, **more: {"symbol": symbol, "call": call, "ordinal": ordinal, "fetched_at": now} | more
    try:
        rows = []
        quote, _ = with_retry(provider.quote, symbol, attempts=1)
        rows.append(row("quote", kv=fields(quote)))
        for call in RETRIED:
            got, error = with_retry(getattr(provider, call), symbol, attempts=int(options.get("attempts", 3)), wait=float(options.get("wait", 2.0)))
            if error:
                rows.append(row(call, error=error))
            elif call == "targets":
                rows.append(row(call, kv=fields(got)))
            elif call == "recommendations" and isinstance(got, list):
                rows += [row(call, i, label=next((v for k, v in kv if k.strip().lower() == "period"), None), kv=kv) for i, x in enumerate(got) if (kv := fields(x)) is not None]
            elif call == "eps_revisions" and isinstance(got, dict):
                rows += [row(call, i, label=str(k), kv=fields(x)) for i, (k, x) in enumerate(got.items())]
            elif call == "earnings_dates" and isinstance(got, list):
                rows += [row(call, i, text=written(x)) for i, x in enumerate(got)]
        return rows
    except Exception as e:  # noqa: BLE001 - the symbol stays, with the reason
        return [row("unhandled", error=f"{type(e).__name__}: {e}")]


def batches_of(symbols: Iterable[str], options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The symbols' rows, some symbols at a time in threads of this task."""
    provider = make_provider(options["provider"], options)
    with ThreadPoolExecutor(int(options.get("workers", WORKERS))) as pool:
        for rows in pool.map(lambda s: symbol_rows(s, provider, options), symbols):
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class SymbolBatch(InputPartition):
    def __init__(self, symbols: list[str]):
        self.symbols = symbols


class AnalystReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        named = self.options.get("symbols")
        symbols = [s for s in (x.strip() for x in named.split(",")) if s] if named is not None else make_provider(self.options["provider"], self.options).symbols()
        n = int(self.options.get("batch", BATCH))
        return [SymbolBatch(symbols[i : i + n]) for i in range(0, len(symbols), n)] or [SymbolBatch([])]

    def read(self, partition: SymbolBatch) -> Iterator[pa.RecordBatch]:
        yield from batches_of(partition.symbols, self.options)


class AnalystSource(DataSource):
    """``spark.read.format("analysts")``. Options: provider (module:Class), symbols (with commas; default: the provider's own),
    batch (symbols of a partition), workers (threads of a task), attempts and wait (retries), and the provider's own."""

    @classmethod
    def name(cls) -> str:
        return "analysts"

    def schema(self) -> str:
        return PAYLOADS

    def reader(self, schema) -> DataSourceReader:
        return AnalystReader(self.options)


def read_payloads(spark: SparkSession, **options: str) -> DataFrame:
    """The payloads that a provider has, by the data source."""
    spark.dataSource.register(AnalystSource)
    return spark.read.format("analysts").options(**options).load()


def fetch_payloads(symbols: DataFrame, **options: str) -> DataFrame:
    """The payloads of a table's symbols, however many: each task fetches those of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batches_of(batch.column("symbol").to_pylist(), options)

    return symbols.select("symbol").mapInArrow(run, PAYLOADS)
