"""Upserts, links, tombstones and cascades over whole tables.

The batch is reduced to one row per key first (`max_by` combines map-side, so a key with a
third of all changes is one row per task), and then meets the target on unique keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import norm_name


def _moment(now: datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return F.lit(now) if isinstance(now, datetime) else now


def latest_changes(
    batch: DataFrame, key: str, seq: str, overwrite: Sequence[str], keep_known: Sequence[str] = ()
) -> DataFrame:
    """One row per key: the `overwrite` columns of its newest change as they are, nulls
    included, and for each `keep_known` column its newest known value."""
    newest = F.max_by(F.struct(*overwrite), F.col(seq)).alias("_new")
    known = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_known
    ]
    return batch.groupBy(key).agg(
        newest, *known, F.max(seq).alias("seq"), F.count(F.lit(1)).alias("n_changes")
    ).select(key, "_new.*", *keep_known, "seq", "n_changes")


def merge_changes(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    overwrite: Sequence[str],
    keep_known: Sequence[str] = (),
    keep_first: Sequence[str] = (),
) -> DataFrame:
    """Target with the changes applied: one full outer join on unique keys.

    `keep_known` columns change only to a known value; `keep_first` columns never change.
    """
    t, c = target.alias("t"), changes.alias("c")
    changed = F.col(f"c.{key}").isNotNull()
    joined = t.join(c, F.col(f"t.{key}") == F.col(f"c.{key}"), "full_outer")

    def pick(name: str) -> Column:
        if name == key:
            return F.coalesce(F.col(f"t.{key}"), F.col(f"c.{key}"))
        if name in keep_known:
            return F.coalesce(F.col(f"c.{name}"), F.col(f"t.{name}"))
        if name in keep_first:
            return F.coalesce(F.col(f"t.{name}"), F.col(f"c.{name}"))
        if name in overwrite:
            return F.when(changed, F.col(f"c.{name}")).otherwise(F.col(f"t.{name}"))
        return F.col(f"t.{name}")

    return joined.select(*[pick(name).alias(name) for name in target.columns])


POSTING_KEEP_KNOWN = ("description", "detail_fetched_at")


def posting_changes(batch: DataFrame, overwrite: Sequence[str], now=None) -> DataFrame:
    """One row per posting of a flattened batch, stamped with the time of collection."""
    moment = _moment(now)
    stamped = batch.withColumn("fetched_at", moment).withColumn(
        "detail_fetched_at", F.when(F.col("is_detailed"), moment)
    )
    return latest_changes(
        stamped, "posting_id", "seq", [*overwrite, "fetched_at"], POSTING_KEEP_KNOWN
    )


def upsert_postings(
    target: DataFrame, batch: DataFrame, overwrite: Sequence[str], now=None
) -> DataFrame:
    """Last change wins; a copy without a description keeps the known one."""
    changes = posting_changes(batch, overwrite, now)
    return merge_changes(
        target, changes, "posting_id", [*overwrite, "fetched_at"], POSTING_KEEP_KNOWN
    )


def upsert_counts(target: DataFrame, batch: DataFrame, key: str = "posting_id") -> DataFrame:
    """One row `(seen, inserted, updated)`; repeats inside the batch count as updates."""
    touched = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = target.select(key, F.lit(True).alias("_known"))
    marked = touched.join(known, key, "left")
    zero = F.lit(0).cast("long")
    return marked.agg(
        F.coalesce(F.sum("n"), zero).alias("seen"),
        F.count_if(F.col("_known").isNull()).alias("inserted"),
    ).select("seen", "inserted", (F.col("seen") - F.col("inserted")).alias("updated"))


EMPLOYER_OVERWRITE = ("employer_name", "url", "trusted")


def upsert_employers(target: DataFrame, batch: DataFrame, now=None) -> DataFrame:
    """Employers named in a flattened batch; the time first seen is kept."""
    named = batch.where(F.col("employer").isNotNull()).select("seq", "employer.*")
    changes = latest_changes(named, "employer_id", "seq", EMPLOYER_OVERWRITE).withColumn(
        "first_seen_at", _moment(now)
    )
    return merge_changes(
        target, changes, "employer_id", EMPLOYER_OVERWRITE, keep_first=("first_seen_at",)
    )


def named_skills(batch: DataFrame) -> DataFrame:
    """Skills named in a flattened batch with the first spelling seen.

    Mentions are reduced to their distinct spellings before a name is normalised, so the
    work on names grows with the vocabulary, and a skill named everywhere combines map-side.
    """
    mentions = batch.select("seq", F.posexplode("skills").alias("place", "label"))
    spellings = mentions.groupBy("label").agg(F.min(F.struct("seq", "place")).alias("first"))
    named = spellings.withColumn("_key", norm_name(F.col("label")))
    # the name leaves as an aggregate: conditions on a grouping key would be pushed down to
    # the mentions and normalise every one of them
    return (
        named.groupBy("_key")
        .agg(F.max("_key").alias("skill_name"), F.min_by("label", "first").alias("display_name"))
        .where(F.col("skill_name") != "")
        .select("skill_name", "display_name")
    )


def upsert_skills(target: DataFrame, batch: DataFrame) -> DataFrame:
    """New skill names join the dimension; the first spelling ever seen is displayed."""
    new = named_skills(batch).join(target.select("skill_name"), "skill_name", "left_anti")
    return target.select("skill_name", "display_name").unionByName(new)


def replace_links(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Links of every posting that names skills are replaced as a whole.

    The newest copy that names skills decides; copies without skills leave the links alone.
    """
    naming = batch.where(F.size("skills") > 0)
    newest = naming.groupBy("posting_id").agg(F.max_by("skills", "seq").alias("skills"))
    kept = target.join(newest.select("posting_id"), "posting_id", "left_anti")
    names = F.array_distinct(F.transform("skills", norm_name))
    new = newest.select("posting_id", F.explode(names).alias("skill_name")).where(
        F.col("skill_name") != ""
    )
    return kept.select("posting_id", "skill_name").unionByName(new)


def batch_report(target: DataFrame, batch: DataFrame) -> DataFrame:
    """One row of counters of a batch against the target it is merged into."""
    counts = upsert_counts(target, batch)
    named = F.transform(F.coalesce("skills", F.array().cast("array<string>")), norm_name)
    links = F.size(F.filter(named, lambda n: n != "")).cast("long")
    # one value of both, so that the batch is worked out once for them
    touched = batch.agg(
        F.struct(
            F.count_if(F.col("employer").isNotNull()).alias("employers_touched"),
            F.coalesce(F.sum(links), F.lit(0)).alias("skills_linked"),
        ).alias("touched")
    ).scalar()
    return counts.withColumn("_touched", touched).select("*", "_touched.*").drop("_touched")


def pending_details(postings: DataFrame, limit: int | None = None) -> DataFrame:
    """Postings without a full card, newest first."""
    queue = (
        postings.where(F.col("detail_fetched_at").isNull())
        .select("posting_id", "published_at")
        .orderBy(F.desc_nulls_last("published_at"), "posting_id")
    )
    return queue if limit is None else queue.limit(limit)


def apply_tombstones(postings: DataFrame, gone: DataFrame, now=None) -> DataFrame:
    """Postings deleted at the source become archived and leave the queue."""
    ids = gone.select("posting_id").distinct().withColumn("_gone", F.lit(True))
    joined = postings.join(ids, "posting_id", "left")
    hit = F.coalesce("_gone", F.lit(False))
    kind = postings.schema["detail_fetched_at"].dataType
    return (
        joined.withColumn("archived", F.col("archived") | hit)
        .withColumn(
            "detail_fetched_at",
            F.when(hit, _moment(now).cast(kind)).otherwise(F.col("detail_fetched_at")),
        )
        .drop("_gone")
        .select(*postings.columns)
    )


def delete_postings(
    ids: DataFrame, postings: DataFrame, links: DataFrame, chunks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the postings and everything that hangs on them."""
    gone = ids.select("posting_id")
    return tuple(t.join(gone, "posting_id", "left_anti") for t in (postings, links, chunks))


def delete_employers(
    ids: DataFrame, employers: DataFrame, postings: DataFrame, links: DataFrame, chunks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Like `delete_postings`, starting from employers."""
    gone = ids.select("employer_id")
    lost = postings.join(gone, "employer_id", "left_semi")
    rest = delete_postings(lost, postings, links, chunks)
    return (employers.join(gone, "employer_id", "left_anti"), *rest)
