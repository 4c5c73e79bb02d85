"""Versioned Parquet tables.

A write goes to a new run directory and counts once `_SUCCESS` is there, so a table can
be rewritten from itself and a lost driver leaves the last good version readable.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from tidemark import schemas

RUN = "run="


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def complete_runs(spark: SparkSession, folder: str, prefix: str = RUN) -> list[str]:
    """Names of the finished run directories in a folder, oldest first."""
    fs, path = _file_system(spark, folder)
    if not fs.exists(path):
        return []
    jvm = spark.sparkContext._jvm
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(
        name
        for name in names
        if name.startswith(prefix)
        and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS"))
    )


def write_table(
    df: DataFrame, root: str, name: str, run: int | None = None, partition_by: tuple[str, ...] = ()
) -> str:
    """Write a new version and return its path.

    `run` makes the write repeatable: the same run number replaces its own directory, never
    another one.  Without it the next free number is taken.
    """
    spark = df.sparkSession
    folder = f"{root}/{name}"
    if run is None:
        done = complete_runs(spark, folder)
        run = int(done[-1][len(RUN) :]) + 1 if done else 0
    target = f"{folder}/{RUN}{run:012d}"
    fs, path = _file_system(spark, target)
    if fs.exists(path):
        own = f"{fs.makeQualified(path).toUri().getPath()}/"
        if any(own in unquote(name) for name in df.inputFiles()):
            raise ValueError(f"{target} is read by the table that would replace it")
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def drop_runs(spark: SparkSession, folder: str, runs: list[str]) -> None:
    """Delete run directories; their `_SUCCESS` goes first, so none is read half deleted."""
    for name in runs:
        fs, path = _file_system(spark, f"{folder}/{name}")
        fs.delete(_file_system(spark, f"{folder}/{name}/_SUCCESS")[1], False)
        fs.delete(path, True)


def latest_path(spark: SparkSession, root: str, name: str) -> str | None:
    done = complete_runs(spark, f"{root}/{name}")
    return f"{root}/{name}/{done[-1]}" if done else None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Newest finished version; an empty table of the known schema before the first write."""
    path = latest_path(spark, root, name)
    if path is None:
        return spark.createDataFrame([], schemas.TABLES[name])
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Tables:
    """The five tables as lazy frames."""

    postings: DataFrame
    employers: DataFrame
    skills: DataFrame
    links: DataFrame
    chunks: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Tables:
        return cls(**{name: read_table(spark, root, name) for name in schemas.TABLES})
