"""Column helpers and shared-folder tables that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that ends a word, as a regular expression's class and as characters.
SPACE_CLASS, SPACE_CHARS = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
#: Most bytes, as width() reckons them, of a small side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64_000_000


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space; a null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in every engine; a null part counts as empty."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on this machine alone, as in local tests, a temporary folder is set instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sparkscreen-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkscreen/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return Tables(df.sparkSession).written(df)


class Tables:
    """Parquet tables of one computation, in a folder of their own in the shared folder, which drop() removes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """To be called when nothing reads the tables any more: what was made of them has been written elsewhere."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def width(df: DataFrame) -> int:
    """Bytes that a row is reckoned at: 16, and 16 a field, 64 for each that is no number."""
    return 16 + sum(64 if kind in ("string", "binary") or "<" in kind else 16 for _, kind in df.dtypes)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within BROADCAST_BYTES, else unchanged: then the join shuffles."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * width(df) <= BROADCAST_BYTES else df
