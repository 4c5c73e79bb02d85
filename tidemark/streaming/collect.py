"""Continuous collection: landed JSON files into the tables, at any cadence.

Each micro-batch writes its own change folder, named by the batch id and replaced whole on a
retry, so a run that is repeated or cut off neither doubles nor loses anything.  Writing
costs what the batch holds; the current tables are the last snapshot with the later changes
merged in, and `compact` makes that the next snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.operators import lifecycle as lc
from tidemark.sources.postings import (
    OVERWRITTEN,
    expand_records,
    flatten_postings,
    split_rejects,
)
from tidemark.sources.tables import complete_runs, drop_runs, latest_path, write_table

CHANGES = "changes"
REJECTS = "rejects"
REJECT_COLUMNS = ("batch", "seq", "collected_at", "problem")


def start_collecting(
    spark: SparkSession, source: str, root: str, checkpoint: str, json_lines: bool = False
) -> StreamingQuery:
    """Take all files landed since the last run; the checkpoint remembers which.

    `checkpoint` belongs in the shared storage of the cluster.
    """
    landed = (
        spark.readStream.format("json")
        .schema("payload variant")
        .option("singleVariantColumn", "payload")
        .option("multiLine", str(not json_lines).lower())
        .load(source)
        .select(
            "payload",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        flat = flatten_postings(expand_records(batch))
        stamped = flat.withColumn("collected_at", F.current_timestamp()).withColumn(
            "batch", F.lit(batch_id)
        )
        write_table(stamped, root, CHANGES, run=batch_id)

    return (
        landed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rejected(spark: SparkSession, root: str) -> DataFrame | None:
    """Records of all finished batches that cannot be loaded, with their source position and the
    reason."""
    base = latest_path(spark, root, "postings")
    upto = _run_number(base) if base else -1
    folder = f"{root}/{REJECTS}"
    kept = [r for r in complete_runs(spark, folder) if _run_number(r) <= upto]
    found = _stored_changes(spark, root, upto)
    parts = [spark.read.parquet(*[f"{folder}/{r}" for r in kept])] if kept else []
    if found is not None:
        parts.append(split_rejects(found)[1].select(*REJECT_COLUMNS))
    return reduce(DataFrame.unionByName, parts) if parts else None


def changes_after(spark: SparkSession, root: str, batch: int = -1) -> DataFrame | None:
    """Usable changes of the finished batches later than `batch`."""
    found = _stored_changes(spark, root, batch)
    return None if found is None else split_rejects(found)[0]


def _stored_changes(spark: SparkSession, root: str, batch: int) -> DataFrame | None:
    folder = f"{root}/{CHANGES}"
    later = [r for r in complete_runs(spark, folder) if _run_number(r) > batch]
    if not later:
        return None
    read = spark.read.parquet(*[f"{folder}/{name}" for name in later])
    # batches follow each other; inside one, the source position decides
    return read.withColumn("seq", F.struct(F.col("batch"), F.col("seq")))


def current_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Postings, employers, skills and links as of the last finished batch."""
    base = latest_path(spark, root, "postings")
    upto = _run_number(base) if base else -1

    def stored(name: str) -> DataFrame:
        if base is None:
            return spark.createDataFrame([], schemas.TABLES[name])
        return spark.read.parquet(f"{root}/{name}/{base.rsplit('/', 1)[1]}")

    tables = {name: stored(name) for name in ("postings", "employers", "skills", "links")}
    batch = changes_after(spark, root, upto)
    if batch is None:
        return tables
    return {
        "postings": _merge_postings(tables["postings"], batch),
        "employers": _merge_employers(tables["employers"], batch),
        "skills": lc.upsert_skills(tables["skills"], batch),
        "links": lc.replace_links(tables["links"], batch),
    }


def _merge_postings(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Like `upsert_postings`, with the stored time of collection of each change."""
    stamped = batch.withColumn("fetched_at", F.col("collected_at")).withColumn(
        "detail_fetched_at", F.when(F.col("is_detailed"), F.col("collected_at"))
    )
    columns = [*OVERWRITTEN, "fetched_at"]
    changes = lc.latest_changes(stamped, "posting_id", "seq", columns, lc.POSTING_KEEP_KNOWN)
    return lc.merge_changes(target, changes, "posting_id", columns, lc.POSTING_KEEP_KNOWN)


def _merge_employers(target: DataFrame, batch: DataFrame) -> DataFrame:
    named = batch.where(F.col("employer").isNotNull()).select("seq", "collected_at", "employer.*")
    first = named.groupBy("employer_id").agg(F.min("collected_at").alias("first_seen_at"))
    changes = lc.latest_changes(named, "employer_id", "seq", lc.EMPLOYER_OVERWRITE).join(
        first, "employer_id"
    )
    return lc.merge_changes(
        target, changes, "employer_id", lc.EMPLOYER_OVERWRITE, keep_first=("first_seen_at",)
    )


def compact(spark: SparkSession, root: str) -> None:
    """Write the current tables as the snapshot of the last finished batch.

    Postings are written last: a snapshot counts once they are there, and one that counts is never
    written again.  Batches that the snapshot before already held are dropped then, so that
    readers of that one are not disturbed; their rejects are kept in a table of their own.
    """
    runs = complete_runs(spark, f"{root}/{CHANGES}")
    if not runs:
        return
    base = latest_path(spark, root, "postings")
    before = _run_number(base) if base else -1
    upto = _run_number(runs[-1])
    if upto <= before:
        return
    tables = current_tables(spark, root)
    rejects = split_rejects(_stored_changes(spark, root, before))[1]
    write_table(rejects.select(*REJECT_COLUMNS), root, REJECTS, run=upto)
    for name in ("employers", "skills", "links", "postings"):
        write_table(tables[name], root, name, run=upto)
    drop_runs(spark, f"{root}/{CHANGES}", [r for r in runs if _run_number(r) <= before])


def _run_number(path: str) -> int:
    return int(path.rsplit("=", 1)[1])
