"""Mixing sources to target weights: each document is repeated by a Poisson count, then all are shuffled.

A source's mean repetition rate is its target share of the whole size over its own size, in characters (each document
counts one more, so that empty ones have a size). A document's count inverts the Poisson distribution of that mean at a
number in [0, 1) hashed from the seed and its id: a lost and recomputed task gives the same copies. Means above
PIECE are split into a sum of smaller Poisson counts, each with its own hash. Copies are then dealt out and sorted by a
hash of seed, id and copy number: a global shuffle that is the same in each run.

Nulls: a null source, like every source without a weight of its own, belongs to the rest; a null text has no characters;
a null id is an id. Rows that share an id share its count. An empty table stays empty. Columns copy and shuffle_key of the
input are replaced. Long texts are only measured.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform

#: Largest mean that one inversion takes.
PIECE = 16.0


def poisson_cdf(mean: float) -> list[float]:
    """P(count <= k) for k from 0, as far as it is below what a hash can reach."""
    term = total = math.exp(-mean)
    cdf = [total]
    while total < 1 - 2.0**-53 and len(cdf) < 40 + 8 * mean:
        term *= mean / len(cdf)
        total += term
        cdf.append(total)
    return cdf


def poisson_count(mean: float, seed: int, key: Column) -> Column:
    """A Poisson count of this mean, by inversion at hashed numbers."""
    if mean <= 0:
        return F.lit(0)
    pieces = math.ceil(mean / PIECE)
    cdf = F.array(*map(F.lit, poisson_cdf(mean / pieces)))

    def invert(j: Column) -> Column:
        u = uniform(F.lit(seed), key, j)
        return F.aggregate(cdf, F.struct(u.alias("u"), F.lit(0).alias("n")), lambda acc, c: F.struct(acc["u"].alias("u"), (acc["n"] + (c <= acc["u"]).cast("int")).alias("n")), lambda acc: acc["n"])

    if pieces == 1:
        return invert(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(pieces - 1)), F.lit(0), lambda acc, j: acc + invert(j))


def mix_sources(docs: DataFrame, weights: dict[str, float], rest: float, seed: int = 0, epochs: float = 1.0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows, each as often as its count says, with columns copy (from 0) and shuffle_key, shuffled.

    weights: target share by source; rest: the share of all other sources together, which keep their proportions. Shares
    of sources without rows go to the others. epochs: the result's size over the input's.
    """
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + 1
    group = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    sizes = {r["g"]: r["n"] for r in docs.groupBy(group.alias("g")).agg(F.sum(size.cast("bigint")).alias("n")).collect()}  # one row a weight
    shares = {g: rest if g is None else weights[g] for g in sizes}
    whole, share = sum(sizes.values()), sum(shares.values())
    count = F.lit(0)
    for g in sorted(sizes, key=lambda g: (g is not None, g)):
        mean = epochs * whole * shares[g] / share / sizes[g] if share else 0.0
        own = poisson_count(mean, seed, F.col(doc_id))
        count = own if g is None else F.when(F.col(source) == g, own).otherwise(count)
    copies = docs.withColumn("__n", count).where(F.col("__n") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
