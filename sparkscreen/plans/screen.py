"""The whole screen as one lazy plan from the four relations to the scored companies."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession

from ..config import ScreenConfig
from ..operators import composite, features, rank, report, series
from ..operators.stored import stored
from ..sources import sinks, testdata

Source = DataFrame | Callable[[], DataFrame]


class Screen:
    """The relations of a screen, each of which is planned when it is first asked for; scored is stored then.

    check: hold the keys of all sides of the joins to one row each, which runs jobs. A source is a DataFrame or makes one."""

    def __init__(self, constituents: Source, bars: Source, analysts: Source, config: ScreenConfig, check: bool = False):
        self._sources, self.config, self.check = {"constituents": constituents, "bars": bars, "analysts": analysts}, config, check

    def _source(self, name: str) -> DataFrame:
        found = self._sources[name]
        return found() if callable(found) else found

    @cached_property
    def constituents(self) -> DataFrame:
        return self._source("constituents")

    @cached_property
    def bars(self) -> DataFrame:
        return self._source("bars")

    @cached_property
    def analysts(self) -> DataFrame:
        return self._source("analysts")

    def store_analysts(self) -> DataFrame:
        """Writes the analyst relation, which may come from remote calls, and has the screen read it from there."""
        self.__dict__["analysts"] = stored(self.analysts)
        return self.analysts

    @cached_property
    def prices(self) -> DataFrame:
        return series.price_metrics(self.constituents, self.bars)

    @cached_property
    def short(self) -> DataFrame:
        return series.short_term_metrics(self.bars)

    @cached_property
    def analysis(self) -> DataFrame:
        return features.build_analysis(self.constituents, self.prices, self.analysts, self.config, self.check)

    @cached_property
    def scored(self) -> DataFrame:
        """All columns; the bars are numbered and aggregated once for price and short-term features. The features are stored
        before the percentiles and the companies before the ranks, as these look at all companies first."""
        both = composite.sector_percentiles(self.constituents, stored(series.all_metrics(self.constituents, self.bars)))
        analysis = features.build_analysis(self.constituents, both, self.analysts, self.config, self.check)
        parts = composite.component_scores(analysis, None, self.config, self.check)
        return composite.with_ranks(composite.composite_scores(parts, self.config))

    def tables(self) -> dict[str, DataFrame]:
        """All tables that an export has. scored, which is stored, feeds all of them."""
        spark = self.scored.sparkSession
        return {
            "constituents": self.constituents,
            "price_metrics": self.prices,
            "analyst_data": self.analysts,
            "all_stocks": self.scored,
            **rank.rankings(self.scored),
            "methodology": report.methodology(spark),
            "run_metadata": report.run_metadata(self.constituents, self.analysts, self.scored, self.config),
        }

    def printed(self) -> dict[str, DataFrame]:
        """The console's tables: the first top_n of each ranking, and the configured ticker's details."""
        n, x = self.config.top_n, self.scored
        return {
            "long_term": rank.top(rank.long_term_ranking(x), rank.LONG_COLUMNS, n, rank.long_order()),
            "short_term": rank.top(rank.short_term_ranking(x), rank.SHORT_COLUMNS, n, rank.short_order()),
            "combined": rank.top(rank.combined_candidates(x), rank.COMBINED_COLUMNS, n, rank.combined_order()),
            "detail": report.ticker_detail(x, self.config.ticker),
        }


def from_testdata(spark: SparkSession, sf_dir: str, config: ScreenConfig | None = None) -> Screen:
    config = config or ScreenConfig(run_ts=testdata.RUN_TS)
    return Screen(lambda: testdata.constituents(spark, sf_dir), lambda: testdata.bars(spark, sf_dir), lambda: testdata.analysts(spark, sf_dir), config)


def run(constituents: DataFrame, bars: DataFrame, analysts: DataFrame, config: ScreenConfig, folder: str | None = None, snapshot: str | None = None, workbook: str | None = None) -> Screen:
    """Builds, checks keys, validates, and exports if the configuration says so, to what is given: CSV files into a folder, a
    snapshot into another, and a workbook at a path of the driver's own, if openpyxl is installed."""
    screen = Screen(constituents, bars, analysts, config, check=True)
    screen.store_analysts()
    report.validate(screen.scored)
    if config.export:
        tables = screen.tables() if folder or snapshot or workbook else {}
        if folder:
            sinks.export_csv(tables, folder, screen.bars)
        if snapshot:
            sinks.export_snapshot(tables, snapshot, config.run_ts)
        if workbook and find_spec("openpyxl"):
            sinks.export_workbook(tables, workbook)
    return screen
