"""Tables stored by key ranges, for lookups of a few rows with wide columns.

Rows are range-partitioned and sorted by key; beside them lies a list of the files with the
first and last key of each.  A lookup of a cut result opens only the files that hold its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import stored

#: Keys of a lookup by files; a longer list of keys is joined with the whole table.
MOST_KEYS = 10_000


@dataclass(frozen=True)
class Clustered:
    """A stored table: where it lies and what it is sorted by."""

    spark: SparkSession
    path: str
    key: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def ranges(self) -> DataFrame:
        """`(file, low, high, n)` of each file."""
        return self.spark.read.parquet(f"{self.path}/ranges")

    def files_of(self, keys: DataFrame) -> list[str]:
        """Files that may hold some of the keys: no more than keys, or two a key where equal keys
        end one file and begin the next."""
        asked = F.broadcast(keys.select(F.col(self.key).alias("_key")))
        inside = (F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high"))
        found = self.ranges().join(asked, inside, "left_semi").select("file")
        return sorted(r["file"] for r in found.collect())

    def lookup(self, keys: DataFrame, columns: list[str] | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
        """Rows of the table whose key is among those of `keys`, with some or all columns.

        The keys are stored first, so what they cost is paid once.  Up to `most_keys` of them
        name the files to read; beyond, the result is the same by a plain join.  Null keys find
        nothing.
        """
        table = self.rows()
        wanted = [self.key, *[c for c in columns or table.columns if c != self.key]]
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        asked = stored(asked, "keys")
        if asked.limit(most_keys + 1).count() > most_keys:
            return table.select(*wanted).join(asked, self.key, "left_semi")
        files = self.files_of(asked)
        if not files:
            return table.select(*wanted).where(F.lit(False))
        some = self.spark.read.schema(table.schema).parquet(*files)
        return some.select(*wanted).join(F.broadcast(asked), self.key, "left_semi")


def write_clustered(df: DataFrame, path: str, key: str, files: int | None = None) -> Clustered:
    """Store df in files of consecutive keys (as many as `files`, else as the session's shuffle
    partitions) with their ranges.  The ranges are read off the stored keys alone.  A key of very
    many rows makes its file large; keys of lookups are expected to be unique or nearly so."""
    spark = df.sparkSession
    parted = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    parted.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    keys = spark.read.parquet(f"{path}/rows").select(F.col(key).alias("key"), "_metadata.file_path")
    ranges = keys.groupBy(F.col("file_path").alias("file")).agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")
    )
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")
    return Clustered(spark, path, key)
