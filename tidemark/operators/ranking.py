"""Top-k and ranking building blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a few unsplittable files dealt out by key to costly row-wise work.

    Only a scan of fewer tasks than the session has slots is dealt out; a table of many files
    is worked on where it is read, without a shuffle.
    """
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(*keys)


def rank_within(df: DataFrame, group: str, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based rank inside each group."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def top_k_within(
    df: DataFrame, group: str, order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """First `k` rows of each group.

    The rank condition lets Spark cut every group to `k` rows in each map task before
    the shuffle, so a hot group costs the reducer at most `k` rows per map task.
    """
    return rank_within(df, group, order, name).where(F.col(name) <= k)


def top_groups(df: DataFrame, keys: Sequence[str], n: int, count: str = "n") -> DataFrame:
    """Largest groups by row count; ties by key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return counted.orderBy(F.desc(count), *keys).limit(n)


def best_per_parent(
    df: DataFrame, parent: Sequence[str], score: str, tie: str, keep: Sequence[str]
) -> DataFrame:
    """Row with the highest score per parent; of equal scores the one with the smallest `tie`.

    A grouped `max_by` instead of a window: the best row is found map-side, so a parent with
    a third of all rows is one row per task in the shuffle.
    """
    order = F.struct(F.col(score), -F.col(tie))
    best = F.max_by(F.struct(score, tie, *[c for c in keep if c not in (score, tie)]), order)
    return df.groupBy(*parent).agg(best.alias("_best")).select(*parent, "_best.*")
