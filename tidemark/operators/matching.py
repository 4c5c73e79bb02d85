"""Matching every posting against candidate profiles.

A profile is the parameter of a match: its lists become literals of one projection, so
matching is a single narrow pass over the postings, without a join or a shuffle.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import EXPERIENCE_ORDER, experience_rank
from tidemark.functions.text import contains_any
from tidemark.operators.ranking import top_k_within
from tidemark.sources.parameters import Profile

# Weight of a skill level, shares of coverage and level in the score, and the
# coverage that makes a good match.
LEVEL_WEIGHT = {"strong": 1.0, "working": 0.7, "basic": 0.4}
COVERAGE_SHARE, LEVEL_SHARE = 0.7, 0.3
GOOD_COVERAGE = 0.6


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _finding(code: str, value: Column | None = None) -> Column:
    text = F.lit(None).cast("string") if value is None else value.cast("string")
    return F.struct(F.lit(code).alias("code"), text.alias("value"))


def _flags(found: Column, code: str) -> Column:
    return F.transform(found, lambda f: _finding(code, f))


def match_columns(profile: Profile, order: tuple[str, ...] = EXPERIENCE_ORDER) -> dict[str, Column]:
    """Match result columns for rows with posting fields and a `skills` array."""
    blockers: list[Column] = []
    notes: list[Column] = []
    low, high = F.col("salary_from_base"), F.col("salary_to_base")
    if profile.salary_min_base is not None:
        floor = profile.salary_min_base
        blockers += [
            F.when(low < floor, _finding("salary_from_low", low)),
            F.when(low.isNull() & (high < floor), _finding("salary_to_low", high)),
        ]
        notes.append(F.when(low.isNull() & high.isNull(), _finding("salary_unknown")))
    if profile.remote_only:
        blockers.append(F.when(~F.col("is_remote"), _finding("not_remote")))
    if profile.employment:
        kind = F.col("employment_id")
        blockers.append(F.when(~kind.isin(*profile.employment), _finding("employment", kind)))
    if profile.max_experience in order:
        accepted = order.index(profile.max_experience)
        needed = experience_rank(F.col("experience_id"), order)
        named = F.coalesce("experience_name", "experience_id")
        blockers.append(F.when(needed > accepted, _finding("experience", named)))

    text = F.concat("title", F.lit("\n"), F.coalesce("description", F.lit("")))
    red = _flags(contains_any(text, profile.red_flags), "red_flag")
    green = _flags(contains_any(text, profile.green_flags), "green_flag")

    skills = F.col("skills")
    held = _strings(list(profile.skills))
    admitted_gaps = sorted(set(profile.missing) - set(profile.skills))
    # the names of a posting are distinct; these keep their order and look up by hash
    matched = F.array_intersect(skills, held)
    missing = F.array_except(skills, held)
    admitted = _flags(F.array_intersect(skills, _strings(admitted_gaps)), "known_gap")
    unnamed = F.size(skills) == 0
    no_skills = F.array_compact(F.array(F.when(unnamed, _finding("no_skills_named"))))

    def listed(findings: list[Column]) -> Column:
        kept = F.array_compact(F.array(*findings)) if findings else F.filter(no_skills, lambda _: F.lit(False))
        return kept

    level = F.lit(0.0)
    parts = [
        F.lit(weight) * F.size(F.array_intersect(F.col("matched_skills"), _strings(names)))
        for name, weight in LEVEL_WEIGHT.items()
        if (names := [s for s, level_ in profile.skills.items() if level_ == name])
    ]
    if parts:
        count = F.size("matched_skills")
        level = F.when(count > 0, reduce(operator.add, parts) / count).otherwise(F.lit(0.0))
    coverage = F.when(unnamed, F.lit(1.0)).otherwise(F.size("matched_skills") / F.size(skills))
    score = F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), COVERAGE_SHARE * F.col("_coverage") + LEVEL_SHARE * level)
    )
    verdict = (
        F.when(F.size("blockers") > 0, F.lit("no"))
        .when((F.col("_coverage") >= GOOD_COVERAGE) & ~unnamed, F.lit("good"))
        .otherwise(F.lit("stretch"))
    )
    return {
        "matched_skills": matched,
        "missing_skills": missing,
        "blockers": F.concat(listed(blockers), red),
        "notes": F.concat(listed(notes), green, admitted, no_skills),
        "_coverage": coverage,
        "score": score,
        "verdict": verdict,
    }


def with_skills(postings: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with their sorted skill names in `skills`."""
    names = links.groupBy("posting_id").agg(
        F.sort_array(F.collect_set("skill_name")).alias("skills")
    )
    return postings.join(names, "posting_id", "left").withColumn(
        "skills", F.coalesce("skills", F.array().cast("array<string>"))
    )


def match_profile(
    postings: DataFrame, profile: Profile, order: tuple[str, ...] = EXPERIENCE_ORDER
) -> DataFrame:
    """Verdict, score and findings of one profile for every posting (with `skills`).

    Findings are codes with a value.  The score, from 0 to 1 and not rounded, says how near the
    skills are and ignores blockers; a posting that names no skills is never better than
    "stretch".
    """
    columns = match_columns(profile, order)
    needed = (
        "posting_id title description salary_from_base salary_to_base is_remote employment_id"
        " experience_id experience_name skills"
    ).split()
    out = postings.select(*[c for c in needed if c in postings.columns])
    for group in (("matched_skills", "missing_skills", "blockers", "notes"), ("_coverage",), ("score", "verdict")):
        out = out.select("*", *[columns[name].alias(name) for name in group])
    return out.select(
        "posting_id",
        "verdict",
        "score",
        "matched_skills",
        "missing_skills",
        "blockers",
        "notes",
    )


#: Profiles matched in one pass over the postings.
PROFILE_BLOCK = 256

_PROFILE = (
    "array<struct<title:string,skills:map<string,string>,missing:array<string>,"
    "salary_min_base:int,remote_only:boolean,employment:array<string>,max_experience:string,"
    "red_flags:array<string>,green_flags:array<string>>>"
)


def _found_in(text: Column, needles: Column) -> Column:
    return F.filter(needles, lambda n: F.contains(text, F.lower(F.trim(n))))


def _blocks(
    p: Column, order: tuple[str, ...], ranks: tuple[Column, Column] | None = None
) -> list[tuple[Column, Column]]:
    """What stands against a posting, as (condition, finding).  `ranks` are the experience that a
    posting needs and that a profile accepts, where they are known."""
    low, high, floor = F.col("salary_from_base"), F.col("salary_to_base"), p["salary_min_base"]
    kind = F.col("employment_id")
    needed, accepted = ranks or (
        experience_rank(F.col("experience_id"), order), experience_rank(p["max_experience"], order)
    )
    named = F.coalesce("experience_name", "experience_id")
    unfit = (F.size(p["employment"]) > 0) & ~F.array_contains(p["employment"], kind)
    return [
        (low < floor, _finding("salary_from_low", low)),
        (low.isNull() & (high < floor), _finding("salary_to_low", high)),
        (p["remote_only"] & ~F.col("is_remote"), _finding("not_remote")),
        (unfit, _finding("employment", kind)),
        (needed > accepted, _finding("experience", named)),
    ]


def _text() -> Column:
    return F.lower(F.concat("title", F.lit("\n"), F.coalesce("description", F.lit(""))))


def _skill_columns(p: Column) -> list[dict[str, Column]]:
    """The columns that depend on the skills of either side alone."""
    skills, held = F.col("skills"), F.map_keys(p["skills"])
    weights = F.create_map(*[F.lit(x) for pair in LEVEL_WEIGHT.items() for x in pair])
    level = F.aggregate(
        "matched_skills",
        F.lit(0.0),
        lambda s, name: s + F.coalesce(F.try_element_at(weights, p["skills"][name]), F.lit(0.0)),
    )
    mean = F.when(F.size("matched_skills") > 0, level / F.size("matched_skills")).otherwise(0.0)
    score = COVERAGE_SHARE * F.col("_coverage") + LEVEL_SHARE * mean
    return [
        {
            "matched_skills": F.array_intersect(skills, held),
            "missing_skills": F.array_except(skills, held),
        },
        {
            "_coverage": F.when(F.size(skills) == 0, F.lit(1.0)).otherwise(
                F.size("matched_skills") / F.size(skills)
            )
        },
        {"score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))},
    ]


def _findings(p: Column, order: tuple[str, ...]) -> dict[str, Column]:
    """Blockers and notes of a posting and a profile."""
    low, high, floor = F.col("salary_from_base"), F.col("salary_to_base"), p["salary_min_base"]
    blockers = [F.when(condition, finding) for condition, finding in _blocks(p, order)]
    unknown = F.when(
        floor.isNotNull() & low.isNull() & high.isNull(), _finding("salary_unknown")
    )
    skills, held = F.col("skills"), F.map_keys(p["skills"])
    unnamed = F.size(skills) == 0
    gaps = F.array_intersect(skills, F.array_except(p["missing"], held))
    return {
        "blockers": F.concat(
            F.array_compact(F.array(*blockers)),
            _flags(_found_in(_text(), p["red_flags"]), "red_flag"),
        ),
        "notes": F.concat(
            F.array_compact(F.array(unknown)),
            _flags(_found_in(_text(), p["green_flags"]), "green_flag"),
            _flags(gaps, "known_gap"),
            F.array_compact(F.array(F.when(unnamed, _finding("no_skills_named")))),
        ),
    }


def _row_columns(p: Column, order: tuple[str, ...]) -> list[dict[str, Column]]:
    """The columns of `match_columns` for a profile that is a struct column."""
    named, coverage, scored = _skill_columns(p)
    verdict = (
        F.when(F.size("blockers") > 0, F.lit("no"))
        .when((F.col("_coverage") >= GOOD_COVERAGE) & (F.size("skills") > 0), F.lit("good"))
        .otherwise(F.lit("stretch"))
    )
    return [named | _findings(p, order), coverage, scored | {"verdict": verdict}]


def with_scores(pairs: DataFrame) -> DataFrame:
    """Pairs of a posting's `skills` and a struct `_p` with the columns of their skills alone."""
    for group in _skill_columns(F.col("_p")):
        pairs = pairs.select("*", *[c.alias(name) for name, c in group.items()])
    return pairs


def _blocked(p: Column, order: tuple[str, ...], ranks: tuple[Column, Column] | None = None) -> Column:
    """Whether `blockers` has an entry, told without making the list."""
    no = F.lit(False)
    said = [F.coalesce(condition, no) for condition, _ in _blocks(p, order, ranks)]
    flags = p["red_flags"]
    flagged = F.exists(flags, lambda n: F.contains(_text(), F.lower(F.trim(n))))
    said.append(F.when(F.size(flags) > 0, F.coalesce(flagged, no)).otherwise(no))
    # the list is null, and holds nothing, where the flags are
    return flags.isNotNull() & reduce(operator.or_, said)


def good_rows(
    pairs: DataFrame,
    order: tuple[str, ...],
    ranks: tuple[Column, Column] | None = None,
    more: Sequence[str] = (),
) -> DataFrame:
    """The good ones of pairs with enough coverage that `with_scores` has seen, as of `match_rows`,
    with `more` of their columns."""
    p = F.col("_p")
    found = {name: c.alias(name) for name, c in _findings(p, order).items()}
    return pairs.where(~_blocked(p, order, ranks)).select(
        p["title"].alias("profile"), "posting_id", F.lit("good").alias("verdict"), "score",
        "matched_skills", "missing_skills", found["blockers"], found["notes"], *more,
    )


def match_rows(
    pairs: DataFrame, order: tuple[str, ...], verdicts: Sequence[str]
) -> DataFrame:
    """Matches of posting rows (with `skills`) and their profile, a struct `_p`."""
    out = pairs
    for group in _row_columns(F.col("_p"), order):
        out = out.select("*", *[c.alias(name) for name, c in group.items()])
    return out.where(F.col("verdict").isin(*verdicts)).select(
        F.col("_p.title").alias("profile"), "posting_id", "verdict", "score",
        "matched_skills", "missing_skills", "blockers", "notes",
    )


def match_profiles(
    postings: DataFrame,
    profiles: Sequence[Profile],
    order: tuple[str, ...] = EXPERIENCE_ORDER,
    verdicts: Sequence[str] = ("good", "stretch"),
    top_n: int | None = None,
) -> DataFrame:
    """Matches of many profiles, told apart by `profile` (the title).

    Each block of PROFILE_BLOCK profiles is one literal list, met by every posting in one narrow
    pass.  Only matches with one of the `verdicts` leave a task; `top_n` keeps the best of each
    profile, ties to the lower posting.
    """
    if not profiles:
        raise ValueError("no profile to match")
    parts = []
    for begin in range(0, len(profiles), PROFILE_BLOCK):
        text = json.dumps([asdict(p) for p in profiles[begin : begin + PROFILE_BLOCK]])
        met = postings.withColumn("_p", F.explode(F.from_json(F.lit(text), _PROFILE)))
        parts.append(match_rows(met, order, verdicts))
    found = reduce(DataFrame.unionByName, parts)
    if top_n is None:
        return found
    best = [F.desc("score"), F.asc("posting_id")]
    return top_k_within(found, "profile", best, top_n)
