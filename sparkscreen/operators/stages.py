"""A barrier between stages of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """The same rows, but the optimizer computes the columns here instead of copying their expressions into each later use.

    Meant for one row a company: all columns of df are computed, whatever is selected later.
    """
    return df.selectExpr("explode(array(struct(*))) as __r").select("__r.*")
