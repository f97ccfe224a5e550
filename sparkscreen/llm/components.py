"""Connected components of a graph given as a DataFrame of links: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """links: a, b (both ways are meant). Rows (node, label): the smallest node reachable, for each node of a link.

    Each round a node takes the least label around it and then its label's label, so that labels settle after about the
    logarithm of the longest path. A round is three shuffles of small rows, with partial minima before each. tables: where
    what is needed between rounds is written.
    """
    w = (tables or Tables(links.sparkSession)).written
    edges = w(links.where(F.col("a") != F.col("b")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = w(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = labels.unionByName(around).groupBy("node").agg(F.min("label").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = least.join(further, "label", "left").select("node", F.least("label", "next").alias("label"))
        new = w(moved)
        if new.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).isEmpty():
            return new
        labels = new
