"""Line dedup by site-relative frequency: lines on more than a given share of a site's pages are boilerplate and go.

A page counts once for each different line it has; a line's key is the line without blanks at its ends, and blank lines
have none and stay. Pages containing each line, by (host, line), are counted with partial sums over 128-bit hashes, so
a site with a third of all pages is spread by its lines; only lines on at least ``min_pages`` pages go on to the join
with the host's total. A host has at most (mean lines a page) / ratio such lines, gathered in one set a host.

Nulls: pages with a null host form one site; a null text stays null and has no lines. Repeated rows are pages of their
own. A page that loses every line keeps an empty text. An empty table stays empty.
Other columns stay. A text is split whole, within its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """Rows (host, lines array<struct<a, b>>) of the hosts that have boilerplate lines."""
    keys = F.filter(F.transform(F.split(F.col(text), "\n"), _key), lambda k: k != "")
    lines = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(keys)).alias("key")).select("host", _hash(F.col("key")).alias("line"))
    pages = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("h")).agg(F.count(F.lit(1)).alias("total"))
    common = pages.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return common.groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """The rows with boilerplate lines taken out of the text, and n_lines, n_dropped (long; columns of these names are replaced)."""
    sets = written(boilerplate(docs, host, text, ratio, min_pages))
    found = small(sets, sets.select(F.sum(F.size("lines"))).first()[0] or 0).select(F.col("host").alias("__host"), F.col("lines").alias("__set"))
    lines = F.split(F.col(text), "\n")
    keep = F.when(F.col("__set").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("__set"), _hash(_key(x)))))
    df = docs.join(found, F.col(host).eqNullSafe(F.col("__host")), "left").withColumns({"__keep": keep, "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint")})
    df = df.withColumn("n_dropped", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("__keep")).cast("bigint"))
    df = df.withColumns({text: F.when(F.col("n_dropped") > 0, F.array_join("__keep", "\n")).otherwise(F.col(text)), "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint")})
    return df.drop("__host", "__set", "__keep")
