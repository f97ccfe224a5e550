"""Quality rules with adaptive thresholds: fences from the quantiles of each language and source, from mergeable sketches.

Fixed base rules come first (BASE). Documents that pass them are measured by integer ratios, and each ratio's values go
into a histogram sketch with log-linear buckets: values below 64 are exact, larger ones keep 5 bits after the leading
one, so that a quantile is off by at most 1/32. A sketch is rows (group, metric, bucket, count); sketches merge by adding
counts, first in each task, then for a source, its language and all together. No cutoff is given as a number: what a metric
sets is a share or a spread.

- A metric with a tail (ratios that are 0 for most documents): the fence is the bucket that holds the 1 - 1/tail quantile of
  the (language, source) group. Where the group has fewer than ``min_docs`` documents, or that quantile is 0, so that the group
  has no usual value but 0, its language's counts, then that of all; if all documents' is 0, the metric rejects nothing.
- A metric with a spread (word length): the fences are quartile -/+ spread * (q75 - q25), at least a bucket wide, of the
  group, or with fewer than ``min_docs`` documents of the language, then of all.

The thresholds are joined by group and a document is kept if each metric lies within its fences.

Everything is integer arithmetic on counts, so the verdicts are the same in each run. Nulls: a null text has no words
and fails the base rules; a null language or source is a group. Repeated rows are judged alike. Empty tables stay empty.
Columns named as one of MEASURES, base_failed or kept are replaced, others stay. A text is taken apart whole, within its row.
Repeated windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, small, words, written

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Metric:
    """(scale * above) div below, and either tail: one in so many may lie beyond the fence, or spread: how often the distance
    of the quartiles lies between them and the fences."""

    name: str
    above: str
    below: str
    scale: int
    tail: int = 0
    spread: int = 0


METRICS = (
    Metric("symbols", "n_symbols", "n_words", 1000, tail=20),
    Metric("dup_lines", "n_dup_lines", "n_lines", 1000, tail=100),
    Metric("repeats", "n_repeat_words", "n_words", 1000, tail=100),
    Metric("word_length", "word_chars", "n_words", 100, spread=4),
)
MIN_DOCS = 30


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window that occurs twice or more; sorted only where some window does."""

    def of(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        at = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j - 1) | same(s, x, j + 1)), lambda x: x["i"])))
        covered = F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with MEASURES (long) and base_failed; each text is taken apart once."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = F.struct((F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"), F.length(F.translate(t, SPACE_CHARS, "")).alias("word_chars"))
    # a generator keeps the optimizer from computing the struct again for each use
    df = docs.withColumn("__m", F.explode(F.array(F.struct(by_words.alias("w"), by_lines.alias("l"), counts.alias("c")))))
    where = {"n_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l", "n_symbols": "c", "word_chars": "c"}
    df = df.withColumns({m: F.col(f"__m.{where[m]}.{m}").cast("bigint") for m in MEASURES}).drop("__m")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratio(m: Metric) -> Column:
    return F.expr(f"({m.scale} * {m.above}) div greatest({m.below}, 1)")


def bucket(v: Column) -> Column:
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(F.expr("bigint(32)") * shift + F.call_function("shiftright", v, shift))


def thresholds(measured: DataFrame, lang: str, source: str, min_docs: int) -> DataFrame:
    """Rows (lang, source, low_0, high_0, ...) for each group of documents that pass the base rules: values for a metric with a
    spread, for one with a tail the last bucket (null: no fence)."""
    sketch = (
        measured.where(~F.col("base_failed"))
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.posexplode(F.array(*(bucket(ratio(m)) for m in METRICS))).alias("metric", "bucket"))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sketch = written(sketch)
    keys = {2: ["lang", "source"], 1: ["lang"], 0: []}
    tail = F.element_at(F.array(*(F.lit(m.tail or 4) for m in METRICS)), F.col("metric") + 1)
    low_end = lambda b: F.when(b < 64, b).otherwise(F.call_function("shiftleft", b - 32 * (F.floor(b / 32) - 1), (F.floor(b / 32) - 1).cast("int")))

    def quantiles(level: int) -> DataFrame:
        by = [*keys[level], "metric"]
        merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
        pairs = F.sort_array(F.collect_list(F.struct("bucket", "n")))  # at most a few hundred buckets
        total = F.aggregate(F.col("s"), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])

        def reach(part: Column, whole: Column) -> Column:
            """The first bucket up to which part / whole of the counts lie."""
            first = lambda a, x: F.coalesce(a["at"], F.when(whole * (a["sum"] + x["n"]) >= part * F.col("total"), x["bucket"]))
            begin = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("at"))
            return F.aggregate(F.col("s"), begin, lambda a, x: F.struct((a["sum"] + x["n"]).alias("sum"), first(a, x).alias("at")), lambda a: a["at"])

        q = merged.groupBy(*by).agg(pairs.alias("s")).withColumn("total", total)
        four = F.lit(4)
        q = q.select(*by, F.col("total").alias(f"n{level}"), low_end(reach(F.lit(1), four)).alias(f"p{level}"), low_end(reach(F.lit(3), four)).alias(f"q{level}"), F.nullif(reach(tail - 1, tail), F.lit(0)).alias(f"t{level}"))
        return q.withColumnsRenamed({k: f"{k}{level}" for k in by})

    groups = sketch.select("lang", "source", "metric").distinct()
    for level in (2, 1, 0):
        on = [F.col(k).eqNullSafe(F.col(f"{k}{level}")) for k in (*keys[level], "metric")]
        test = on[0]
        for x in on[1:]:
            test = test & x
        groups = groups.join(quantiles(level), test, "left")
    enough = lambda level, x: F.when(F.col(f"n{level}") >= min_docs, F.col(f"{x}{level}"))
    pick = lambda x: F.coalesce(enough(2, x), enough(1, x), F.col(f"{x}0")).alias(x)
    groups = groups.select("lang", "source", "metric", pick("p"), pick("q"), pick("t"))
    reach = lambda m: F.greatest(m.spread * (F.col("q") - F.col("p")), F.expr("q div 32 + 1"))
    sides = []
    for i, m in enumerate(METRICS):
        mine = lambda c, i=i: F.max(F.when(F.col("metric") == i, c))
        sides += [mine(F.col("p") - reach(m)).alias(f"low_{i}"), mine(F.col("q") + reach(m)).alias(f"high_{i}")] if m.spread else [mine(F.col("t")).alias(f"high_{i}")]
    return groups.groupBy("lang", "source").agg(*sides)


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of measure() with kept: false if base_failed, else whether all metrics lie within their fences."""
    fences = small(written(thresholds(measured, lang, source, min_docs))).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    df = measured.join(fences, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    inside = F.lit(True)
    for i, m in enumerate(METRICS):
        inside = inside & ((ratio(m) <= F.col(f"high_{i}")) & (ratio(m) >= F.col(f"low_{i}")) if m.spread else F.coalesce(bucket(ratio(m)) <= F.col(f"high_{i}"), F.lit(True)))
    df = df.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False)))
    return df.drop("__lang", "__source", *(f"{s}_{i}" for i in range(len(METRICS)) for s in ("low", "high")))
