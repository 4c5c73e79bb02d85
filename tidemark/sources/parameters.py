"""Parameter tables: labelled queries and candidate profiles.

They are written by hand, yet their size is never taken on trust: they stay tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import norm_name


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled relevance queries from JSON."""
    raw = spark.read.schema(schemas.QUERY_SET).option("multiLine", "true").json(path)
    return raw.select(
        "query_id",
        "query",
        F.coalesce("intent", F.lit("")).alias("intent"),
        F.coalesce("relevant_ids", F.array().cast("array<bigint>")).alias("relevant_ids"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"),
    )


@dataclass(frozen=True)
class Profile:
    """One candidate's requirements, the parameter of a match."""

    title: str = ""
    experience_years: float = 0.0
    skills: dict[str, str] = field(default_factory=dict)
    missing: tuple[str, ...] = ()
    salary_min_base: int | None = None
    remote_only: bool = False
    relocation: bool = False
    employment: tuple[str, ...] = ()
    max_experience: str | None = None
    english_speaking: bool = False
    red_flags: tuple[str, ...] = ()
    green_flags: tuple[str, ...] = ()


def profiles_frame(raw: DataFrame) -> DataFrame:
    """Profile rows with skill names in the same normal form as the collected skills.

    `problem` names what makes a row unusable and is null for a good one.
    """
    entries = F.transform(
        F.coalesce("skills", F.array().cast("array<struct<name:string,level:string>>")),
        lambda s: F.struct(norm_name(s["name"]).alias("name"), s["level"].alias("level")),
    )
    # of two spellings of one skill the later one counts
    later = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
            lambda o: o["name"] == e["name"],
        ),
    )
    bad_skill = F.exists(entries, lambda e: e["name"].isNull() | e["level"].isNull())
    problem = (
        F.when(F.col("title").isNull(), F.lit("title is missing"))
        .when(F.col("experience_years").isNull(), F.lit("experience_years is missing"))
        .when(bad_skill, F.lit("a skill lacks its name or level"))
    )
    c = F.col("constraints")
    empty = F.array().cast("array<string>")
    return raw.select(
        "title",
        "experience_years",
        F.when(problem.isNull(), F.map_from_entries(later)).alias("skills"),
        F.transform(F.coalesce("missing", empty), norm_name).alias("missing"),
        c["salary_min_base"].alias("salary_min_base"),
        F.coalesce(c["remote_only"], F.lit(False)).alias("remote_only"),
        F.coalesce(c["relocation"], F.lit(False)).alias("relocation"),
        F.coalesce(c["employment"], empty).alias("employment"),
        c["max_experience"].alias("max_experience"),
        F.coalesce(c["english_speaking"], F.lit(False)).alias("english_speaking"),
        F.coalesce("red_flags", empty).alias("red_flags"),
        F.coalesce("green_flags", empty).alias("green_flags"),
        problem.alias("problem"),
    )


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Profiles from JSON: usable rows, and the rest with their `problem`."""
    raw = spark.read.schema(schemas.PROFILES).option("multiLine", "true").json(path)
    frame = profiles_frame(raw)
    return (
        frame.where(F.col("problem").isNull()).drop("problem"),
        frame.where(F.col("problem").isNotNull()),
    )


def as_profile(row: Row) -> Profile:
    values = row.asDict()
    for name in ("missing", "employment", "red_flags", "green_flags"):
        values[name] = tuple(values[name])
    return Profile(**values)
