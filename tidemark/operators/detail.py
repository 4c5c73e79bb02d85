"""Full posting cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posting_detail(
    postings: DataFrame,
    employers: DataFrame,
    links: DataFrame,
    ids: Sequence[int] | None = None,
) -> DataFrame:
    """Cards with the employer nested and the skill names sorted.

    For listed ids the condition is pushed into all scans; without a list every posting
    gets its card.  One posting's skills are distinct names, combined map-side.
    """
    if ids is not None:
        wanted = F.col("posting_id").isin(*ids)
        postings, links = postings.where(wanted), links.where(wanted)
    skills = links.groupBy("posting_id").agg(
        F.sort_array(F.collect_set("skill_name")).alias("skills")
    )
    card = F.when(
        F.col("e.employer_id").isNotNull(),
        F.struct(*[F.col(f"e.{c}").alias(c) for c in employers.columns]),
    )
    return (
        postings.alias("p")
        .join(skills.alias("s"), "posting_id", "left")
        .join(employers.alias("e"), F.col("p.employer_id") == F.col("e.employer_id"), "left")
        .select(
            *[F.col("posting_id") if c == "posting_id" else F.col(f"p.{c}") for c in postings.columns if c != "employer_id"],
            card.alias("employer"),
            F.coalesce("s.skills", F.array().cast("array<string>")).alias("skills"),
        )
    )
