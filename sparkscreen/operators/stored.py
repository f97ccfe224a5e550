"""Tables between the steps of a screen."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder that driver and executors share. Where that is unset and the
    master is this machine alone, it is set to a temporary folder; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkscreen-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/screen/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once: written as Parquet and read from there, which also survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
