"""A corpus pipeline of five operators: quality rules, line dedup, near-duplicate removal, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), docs as its predecessor left them, and returns a DataFrame; all but the last return
the columns of documents. run() writes each stage's rows to the shared folder and reads them back for the next, after which
the rows of the stage before go. What the operators define for nulls, repeated rows, very long texts and empty tables holds
here: a null text fails the quality rules, so later stages meet none; rows with a null id stay, each as it is; of rows that
share an id one stays; columns beside those of documents, whatever their names, are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscreen.llm import decontam, jaccard, lines, mixing, oracles, quality
from sparkscreen.llm.common import Tables, written
from sparkscreen.llm.queries import LINE_PAGES, LINE_RATIO, MIX_REST, MIX_SEED, MIX_WEIGHTS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go. Each text is measured once: fences and
    verdicts read what was written."""
    measured = written(quality.measure(docs.select(*COLUMNS)))
    return quality.judge(measured).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows a text that changed."""
    cleaned = lines.drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=list(COLUMNS))
    return found.where(F.size("found.spans") == 0).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by Poisson counts to the sources' target weights, shuffled."""
    return mixing.mix_sources(docs, MIX_WEIGHTS, MIX_REST, MIX_SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
]

ORACLE_SQL: str | None = oracles.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        own = Tables(spark)
        docs = own.written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
