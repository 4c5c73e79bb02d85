"""Skill and market statistics.

Exact percentiles are taken over integer amounts.  Every statistic first counts rows per
(group, amount): that aggregate combines map-side and its shuffle key includes the amount,
so a group with a third of all rows is spread over all tasks, and what reaches the per-group
step is one row per distinct amount.  `percentile` with a frequency column then interpolates
exactly as a continuous percentile over the rows does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import clamp_limit
from tidemark.operators.ranking import top_groups

SALARY = "salary_from_base"


def _require_whole(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise TypeError(f"{column} must be a whole-number column: its distinct values bound the work")


def amount_counts(
    df: DataFrame, keys: Sequence[str], amount: str = SALARY, **also: Column
) -> DataFrame:
    """Rows per (keys, amount) as `n`; `also` adds further sums."""
    _require_whole(df, amount)
    extra = [column.alias(name) for name, column in also.items()]
    return df.groupBy(*keys, amount).agg(F.count(F.lit(1)).alias("n"), *extra)


def percentile_of(amount: str, share: float, n: str = "n") -> Column:
    """Continuous percentile of counted amounts, fraction dropped; nulls do not count."""
    return F.percentile(F.col(amount), F.lit(share), F.col(n)).cast("long")


def skill_stats(
    postings: DataFrame, links: DataFrame, skills: DataFrame, top_n: int = 30, max_limit: int | None = None
) -> DataFrame:
    """Most demanded skills of a market slice.

    `share` relates to all postings of the slice, also those naming no skill; the median
    covers postings with a known salary.  `max_limit`, if given, holds `top_n` down.
    """
    slice_ = postings.select("posting_id", SALARY)
    total = slice_.agg(F.count(F.lit(1)).alias("total"))
    counted = amount_counts(slice_.join(links, "posting_id"), ["skill_name"])
    top = (
        counted.groupBy("skill_name")
        .agg(F.sum("n").alias("posting_count"), percentile_of(SALARY, 0.5).alias("median_salary"))
        .orderBy(F.desc("posting_count"), "skill_name")
        .limit(clamp_limit(top_n, max_limit))
    )
    share = F.col("posting_count") / scalar(total)
    return (
        skills.join(top, "skill_name")
        .select(
            "skill_name",
            "display_name",
            "posting_count",
            share.alias("share"),
            "median_salary",
        )
        .orderBy(F.desc("posting_count"), "skill_name")
    )


def scalar(one_row: DataFrame) -> Column:
    """A one-row, one-column frame as a value (an uncorrelated scalar subquery)."""
    return one_row.scalar()


def market_totals(postings: DataFrame) -> DataFrame:
    """One row: size of the slice, salary quartiles, share of remote work (0 when empty)."""
    remote = F.count_if(F.col("is_remote"))
    counted = amount_counts(postings, [], remote=remote)
    known = F.when(F.col(SALARY).isNotNull(), F.col("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return counted.agg(
        total.alias("total"),
        F.coalesce(F.sum(known), F.lit(0)).cast("long").alias("with_salary"),
        percentile_of(SALARY, 0.25).alias("salary_p25"),
        percentile_of(SALARY, 0.5).alias("salary_p50"),
        percentile_of(SALARY, 0.75).alias("salary_p75"),
        F.coalesce(F.try_divide(F.sum("remote"), F.sum("n")), F.lit(0.0)).alias("remote_share"),
    )


def by_experience(postings: DataFrame) -> DataFrame:
    known = postings.where(F.col("experience_id").isNotNull())
    counted = known.groupBy("experience_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "experience_id")


def top_employers(postings: DataFrame, employers: DataFrame, n: int = 10) -> DataFrame:
    """Employers with most postings; two employers of one name stay two.

    Postings are counted per key before the join, and only employers on record count.
    """
    counted = (
        postings.where(F.col("employer_id").isNotNull())
        .groupBy("employer_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = counted.join(employers.select("employer_id", "employer_name"), "employer_id")
    return named.orderBy(F.desc("n"), "employer_id").limit(n)


def salary_by_experience(postings: DataFrame) -> DataFrame:
    """Median salary per required experience (unknown included), highest first."""
    counted = amount_counts(
        postings.where(F.col(SALARY).isNotNull()), ["experience_id"]
    )
    medians = counted.groupBy("experience_id").agg(
        F.percentile(F.col(SALARY), F.lit(0.5), F.col("n")).alias("median"), F.sum("n").alias("n")
    )
    return (
        medians.where(F.col("median") != 0)
        .orderBy(F.desc("median"), F.asc_nulls_last("experience_id"))
        .select("experience_id", F.col("median").alias("median_salary"), "n")
    )


def weekly_counts(df: DataFrame, ts: str = "published_at") -> DataFrame:
    """Rows per week, weeks starting on Monday; unknown times left out, gaps not filled."""
    kind = df.schema[ts].dataType
    week = F.date_trunc("week", F.col(ts)).cast(kind)
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(week.alias("week"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("week")
    )


def data_status(
    postings: DataFrame, employers: DataFrame, skills: DataFrame, chunks: DataFrame
) -> DataFrame:
    """One row: table sizes, the main embedding model, and the time range covered."""
    one = F.count(F.lit(1))
    posted = postings.agg(
        one.alias("postings_total"),
        F.min("published_at").alias("published_from"),
        F.max("published_at").alias("published_to"),
        F.max("fetched_at").alias("last_fetched_at"),
    )
    per_model = chunks.groupBy("model_name").agg(
        one.alias("n"), F.count("embedding").alias("embedded")
    )
    # `min_by` over (-n, name): most chunks first, then the name
    # one struct, so that the chunks are read once
    cut = per_model.agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_total"),
            F.coalesce(F.sum("embedded"), F.lit(0)).alias("chunks_embedded"),
            F.min_by("model_name", F.struct(-F.col("n"), F.col("model_name"))).alias("model_name"),
        ).alias("cut")
    )
    return posted.withColumn("_cut", scalar(cut)).select(
        "postings_total",
        scalar(employers.agg(one)).alias("employers_total"),
        scalar(skills.agg(one)).alias("skills_total"),
        "_cut.chunks_total",
        "_cut.chunks_embedded",
        "_cut.model_name",
        "published_from",
        "published_to",
        "last_fetched_at",
    )


def market_report(
    postings: DataFrame,
    employers: DataFrame,
    skills: DataFrame,
    links: DataFrame,
    chunks: DataFrame,
    top_skills: int = 15,
    demo_below: int = 200,
) -> dict[str, DataFrame]:
    """Frames of the aggregate report, all over the same postings."""
    status = data_status(postings, employers, skills, chunks)
    return {
        "database": status.withColumn("demo", F.col("postings_total") < demo_below),
        "market": market_totals(postings),
        "by_experience": by_experience(postings),
        "top_employers": top_employers(postings, employers),
        "top_skills": skill_stats(postings, links, skills, top_skills),
        "salary_by_experience": salary_by_experience(postings),
        "weekly_published": weekly_counts(postings),
    }


__all__ = [
    "amount_counts",
    "by_experience",
    "data_status",
    "market_report",
    "market_totals",
    "percentile_of",
    "salary_by_experience",
    "skill_stats",
    "top_employers",
    "top_groups",
    "weekly_counts",
]
