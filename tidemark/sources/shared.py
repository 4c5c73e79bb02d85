"""The folder that driver and executors share, for tables a query stores on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir.  Where that is unset, as in local tests, the session
    gets a temporary folder; on a cluster it has to be set."""
    name = "spark.checkpoint.dir"
    folder = spark.sparkContext.getConf().get(name, None) or spark.conf.get(name, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {name} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(name, folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: made once however often it is read, and
    still there when executors are lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
