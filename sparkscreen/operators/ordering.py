"""Row numbers, ranks and percentiles over all rows without a window that holds them all.

Rows are range-partitioned on the sort keys, sorted within partitions and stored with an id that rises from partition to
partition and row to row. What a partition holds is counted, a row a partition, and the sums before each partition are added
to the places within it. Ranks come from counts of distinct values instead of rows: tasks count before the shuffle, so neither
many ties nor one large group meet in a task. NULL is a value of its own; NaN equals NaN.

min_ranks() and percentile_in_group() read the columns that they order by before df itself is read: store a df that is dear, or
give them, as ``of``, the rows before what made it dear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stored import stored

#: Bits of the place within a partition in the ids that Spark gives out.
PLACE_BITS = 33
#: Values whose places are sent to the tasks, at most; df is shuffled by its values, few of which would leave tasks idle, beyond it.
SENT_VALUES = 1 << 16


def in_order(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows stored in order with __part and __place: the partition, and the place in it from 0."""
    t = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()))
    return t.select(*df.columns, F.shiftright("__id", PLACE_BITS).alias("__part"), (F.col("__id") % (1 << PLACE_BITS)).alias("__place"))


def before_parts(ordered: DataFrame, weight: Column) -> tuple[DataFrame, int]:
    """(rows (__part, __ahead): the weight of all partitions before it; how many rows are ordered). One row a partition, which the
    driver adds up."""
    sums = sorted(tuple(r) for r in ordered.groupBy("__part").agg(F.sum(weight), F.count(F.lit(1))).collect())
    ahead, rows = 0, []
    for part, n, _ in sums:
        rows.append((part, ahead))
        ahead += n
    return F.broadcast(ordered.sparkSession.createDataFrame(rows, "__part bigint, __ahead bigint")), sum(n for _, _, n in sums)


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with its row numbers by keys, from 1, as a first column; rows that are equal in all keys follow in any order."""
    t = in_order(df, keys)
    return t.join(before_parts(t, F.lit(1))[0], "__part").select((F.col("__ahead") + F.col("__place") + 1).alias(name), *df.columns)


def value_places(df: DataFrame, group: str, value: str, descending: bool = False) -> DataFrame:
    """Rows (group, value, ahead, ties, total), one for each pair: how many rows of the group have a value before it, how many
    have this one, and how many there are. Nulls come last when descending, else first. Up to SENT_VALUES rows have a broadcast hint."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("ties"))
    t = in_order(counts, [F.col(group).asc(), F.col(value).desc_nulls_last() if descending else F.col(value).asc()])
    inside = F.sum("ties").over(W.partitionBy("__part").orderBy("__place").rowsBetween(W.unboundedPreceding, -1))
    before, values = before_parts(t, F.col("ties"))
    summed = t.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(before, "__part")
    placed = summed.select(group, value, (F.col("__ahead") + F.col("__inside")).alias("ahead"), "ties")
    groups = placed.groupBy(F.col(group).alias("__g")).agg(F.min("ahead").alias("__start"), F.sum("ties").alias("total"))
    # a few groups with many values are stored, so that Spark sees how small they are and sends them instead of a group to one task
    few = values <= SENT_VALUES
    groups = F.broadcast(groups) if few else stored(groups)
    places = placed.join(groups, F.col(group).eqNullSafe(F.col("__g"))).select(group, value, (F.col("ahead") - F.col("__start")).alias("ahead"), "ties", "total")
    return F.broadcast(places) if few else places


def with_places(df: DataFrame, places: DataFrame, on: dict[str, Column], columns: dict[str, Column]) -> DataFrame:
    """df with columns made of places, whose rows are found by null-safe equality of places' columns with expressions over df."""
    renamed = places.select(*(F.col(c).alias(f"__{c}") for c in places.columns))
    same = F.lit(True)
    for c, own in on.items():
        same = same & own.eqNullSafe(F.col(f"__{c}"))
    return df.join(renamed, same, "left").select(*df.columns, *(c.alias(name) for name, c in columns.items()))


def min_ranks(df: DataFrame, scores: dict[str, tuple[str, Column]], of: DataFrame | None = None) -> DataFrame:
    """df with a column for each of scores, name: (score, which rows are ranked): 1 plus the ranked rows of a higher
    score, NULL scores last; NULL for other rows. All scores are ranked together, as groups of (name, score). ``of``: the same
    rows with the scores, to be counted in df's place."""
    rows = df if of is None else of
    parts = [rows.where(able).select(F.lit(name).alias("which"), F.col(score).cast("double").alias("score")) for name, (score, able) in scores.items()]
    long = reduce(DataFrame.unionByName, parts)
    places = value_places(long, "which", "score", descending=True).select("which", "score", (F.col("ahead") + 1).alias("rank"))
    for name, (score, able) in scores.items():
        own = places.where(F.col("which") == name).select("score", "rank")
        df = with_places(df.withColumn("__able", able), own, {"score": F.col(score).cast("double")}, {name: F.when(F.col("__able"), F.col("__rank"))}).drop("__able")
    return df


def percentile_in_group(df: DataFrame, value: str, group: str, alias: str, least: int = 5) -> DataFrame:
    """df with the average rank over the number of values in per cent; NULL in groups of fewer values and for a NULL
    group or value. Average ranks come from counts of values, so a group that has most rows is spread over tasks."""
    places = value_places(df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value), group, value)
    rank = F.col("__ahead") + 1 + (F.col("__ties") - 1) / 2
    share = F.when(F.col("__total") >= least, rank / F.col("__total") * 100)
    return with_places(df, places, {group: F.col(group), value: F.col(value)}, {alias: share})
