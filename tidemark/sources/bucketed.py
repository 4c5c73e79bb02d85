"""Tables kept in key buckets, so that a batch rewrites only the buckets it touches.

A version of the table is a manifest: a small table that names a folder for each bucket.  A merge
writes the touched buckets to new folders and then a manifest that points to them and, for all
other buckets, to the old ones.  A manifest counts once its `_SUCCESS` is there and is never changed,
so a reader sees one whole version and a write that is cut off leaves the last one as it was.
One writer per table.

Rows are dealt out by a hash of `key`; rows without a key share one bucket.  A bucket is written by
one task or more, so keep few rows per key: postings, cards and links are, a log of events is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.tables import RUN, _file_system, complete_runs, drop_runs, write_table

_BUCKET = "_bucket"
_MANIFEST = "bucket int, folder string"


@dataclass(frozen=True)
class BucketedTable:
    """A table of `schema` under `root`, in `buckets` buckets of `key`.

    Key, number of buckets and schema belong to the table and must stay the same over its life.
    """

    spark: SparkSession
    root: str
    key: str
    schema: T.StructType
    buckets: int = 256

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def version(self) -> str | None:
        """Name of the newest whole version."""
        done = complete_runs(self.spark, f"{self.root}/manifest")
        return done[-1] if done else None

    def manifest(self, version: str | None = None) -> dict[int, str]:
        """Folder of each bucket that holds rows; at most `buckets` entries."""
        version = version or self.version()
        if version is None:
            return {}
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/{version}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def read(self, only: list[int] | None = None, version: str | None = None) -> DataFrame:
        """The newest or the given version; `only` restricts it to some buckets."""
        held = self.manifest(version)
        folders = [held[b] for b in sorted(held) if only is None or b in set(only)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def replace(self, rows: DataFrame) -> None:
        """A version that holds these rows and nothing else."""
        self._write_manifest(self._write_rows(rows))

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Apply `merged(target, batch)` to the buckets of the batch and return their numbers.

        `merged` must decide each key from the rows of this key alone, as the upserts of
        `operators.lifecycle` do.  The batch is read twice: for its buckets and for the merge.
        """
        found = batch.select(self.bucket_of().alias("bucket")).distinct().collect()
        touched = sorted(r["bucket"] for r in found)
        if touched:
            held = self.manifest()
            new = self._write_rows(merged(self.read(touched), batch))
            stray = sorted(set(new) - set(touched))
            if stray:
                raise ValueError(f"the merge made rows of buckets that it did not read: {stray[:5]}")
            kept = {b: f for b, f in held.items() if b not in set(touched)}
            self._write_manifest(kept | new)
        return touched

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop all but the newest `keep` versions and the folders that none of these names.

        Not while a write runs: its folders are named by no version yet.
        """
        done = complete_runs(self.spark, f"{self.root}/manifest")
        drop_runs(self.spark, f"{self.root}/manifest", done[:-keep])
        wanted = {f.split("/")[1] for v in done[-keep:] for f in self.manifest(v).values()}
        fs, data = _file_system(self.spark, f"{self.root}/data")
        writes = [s.getPath().getName() for s in fs.listStatus(data)] if fs.exists(data) else []
        unused = sorted(set(writes) - wanted)
        for name in unused:
            fs.delete(_file_system(self.spark, f"{self.root}/data/{name}")[1], True)
        # a write may survive in part: buckets that a later version replaced go one by one
        named = {f for v in done[-keep:] for f in self.manifest(v).values()}
        for name in set(writes) & wanted:
            for folder in self._bucket_folders(name).values():
                if folder not in named:
                    fs.delete(_file_system(self.spark, f"{self.root}/{folder}")[1], True)
                    unused.append(folder)
        return unused

    def _bucket_folders(self, name: str) -> dict[int, str]:
        fs, path = _file_system(self.spark, f"{self.root}/data/{name}")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        prefix = f"{_BUCKET}="
        return {int(n[len(prefix) :]): f"data/{name}/{n}" for n in names if n.startswith(prefix)}

    def _write_rows(self, rows: DataFrame) -> dict[int, str]:
        name = uuid.uuid4().hex
        dealt = rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket_of()).repartition(_BUCKET)
        dealt.write.partitionBy(_BUCKET).parquet(f"{self.root}/data/{name}")
        return self._bucket_folders(name)

    def _write_manifest(self, folders: dict[int, str]) -> None:
        last = self.version()
        number = int(last[len(RUN) :]) + 1 if last else 0
        rows = self.spark.createDataFrame(sorted(folders.items()), _MANIFEST)
        write_table(rows.coalesce(1), self.root, "manifest", number)
