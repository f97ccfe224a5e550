"""Left joins that hold both sides to one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows (key, rows) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, key: str = "symbol") -> None:
    found = [r[key] for r in duplicates(df, key).limit(5).collect()]
    if found:
        raise ValueError(f"{key} isn't unique: {found}")


def left_join_one_to_one(left: DataFrame, right: DataFrame, key: str = "symbol", check: bool = True) -> DataFrame:
    """left with the columns of right; without a hint, so that Spark picks the strategy from the sizes it sees."""
    if check:
        require_unique(left, key)
        require_unique(right, key)
    return left.join(right, key, "left")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order. Tasks pick among their own rows first, so a key sends a row a task."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("__row")).select("__row.*")
