"""Good matches of a table of profiles with all postings, as a set-similarity join.

A match is good when the profile holds at least GOOD_COVERAGE of a posting's skills.  Of n skills
it then holds one of any n - need + 1, so a posting probes the profiles by its rarest ones alone
(the prefix filter of set joins, on the posting's side only, as coverage counts its skills only).
Coverage and score depend on the skills alone, so they are told once for each map of skills that
profiles have, and the profiles of a map then meet its postings.  Whatever a posting, a profile or a
map says alone is worked out before they meet: the matches may be as many as all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fields import EXPERIENCE_ORDER, experience_rank
from tidemark.operators.matching import GOOD_COVERAGE, good_rows, with_scores
from tidemark.operators.ranking import top_k_within
from tidemark.sources.shared import stored

#: Rows of one skill, or one map of skills, that may meet in one task: postings, and what they meet.
#: A task holds the latter, some 2 MB.
CELL_ROWS = 10_000
CELL_HOLDERS = 10_000

_WANTED = (
    "title skills missing salary_min_base remote_only employment max_experience red_flags green_flags"
).split()


def skill_rarity(links: DataFrame, profiles: DataFrame) -> DataFrame:
    """`(skill_name, n_profiles, n_postings)` of each skill that a posting names."""
    held = profiles.select(F.explode(F.map_keys("skills")).alias("skill_name"))
    holders = held.groupBy("skill_name").agg(F.count(F.lit(1)).alias("n_profiles"))
    named = links.groupBy("skill_name").agg(F.count(F.lit(1)).alias("n_postings"))
    return named.join(holders, "skill_name", "left").fillna(0, ["n_profiles"])


def _need(n: Column) -> Column:
    """How many of `n` skills a good match holds at least."""
    # a hair less than the product, which may come out above a whole number
    return F.ceil(F.lit(GOOD_COVERAGE) * n - 1e-9).cast("int")


def promising(links: DataFrame, rarity: DataFrame) -> DataFrame:
    """Distinct links of the postings with enough skills that any profile holds: no other can match.

    Told by two counts a posting, so the skills of the others are never listed.
    """
    held = rarity.select("skill_name", (F.col("n_profiles") > 0).cast("int").alias("_held"))
    counted = links.join(held, "skill_name").groupBy("posting_id")
    enough = counted.agg(F.count(F.lit(1)).alias("_n"), F.sum("_held").alias("_m")).where(
        F.col("_m") >= _need(F.col("_n"))
    )
    return links.join(stored(enough.select("posting_id"), "promising"), "posting_id", "left_semi")


def probes(links: DataFrame, rarity: DataFrame) -> DataFrame:
    """Rows `(posting_id, skills, skill_name, earlier, n_profiles, n_postings)`: the skills by
    which a posting looks for profiles, rarest first, with those before each in `earlier`.

    Skills that no profile holds come first and use up the prefix, so most postings that cannot
    match probe nothing.  The skills of one posting meet in one row, not those of a group.
    """
    ranked = (
        links.select("posting_id", "skill_name")
        .join(rarity, "skill_name")
        .groupBy("posting_id")
        .agg(F.sort_array(F.collect_set(F.struct("n_profiles", "n_postings", "skill_name"))).alias("_r"))
    )
    n = F.size("_r")
    need = _need(n)
    cut = ranked.select(
        "posting_id",
        F.sort_array(F.col("_r.skill_name")).alias("skills"),
        F.slice("_r", F.lit(1), n - need + 1).alias("_prefix"),
    )
    return (
        cut.select("posting_id", "skills", "_prefix", F.posexplode("_prefix").alias("_at", "_one"))
        .where(F.col("_one.n_profiles") > 0)
        .select(
            "posting_id", "skills", "_one.skill_name",
            F.slice(F.col("_prefix.skill_name"), F.lit(1), F.col("_at")).alias("earlier"),
            "_one.n_profiles", "_one.n_postings",
        )
    )


def _cells(count: str, rows: int) -> Column:
    return F.ceil(F.col(count) / rows).cast("int")


def _cell(key: Column, count: str, rows: int) -> Column:
    return F.pmod(F.xxhash64(key), _cells(count, rows)).cast("int")


def _copies(count: str, rows: int) -> Column:
    return F.explode(F.sequence(F.lit(0), _cells(count, rows) - 1))


def _skill_map() -> Column:
    """The map of skills as a value that can be grouped and joined by."""
    return F.sort_array(F.map_entries("skills"))


def skill_maps(profiles: DataFrame) -> DataFrame:
    """`(_map, skills, n_holders)` of each map of skills that profiles have."""
    held = profiles.where(F.size("skills") > 0).groupBy(_skill_map().alias("_map"))
    return held.agg(F.count(F.lit(1)).alias("n_holders")).select(
        "_map", F.map_from_entries("_map").alias("skills"), "n_holders"
    )


def candidate_pairs(links: DataFrame, maps: DataFrame, rarity: DataFrame) -> DataFrame:
    """`(posting_id, skills, _p, _map, n_holders)` of all postings and maps of skills with enough
    coverage, each pair once; `_p` has the map as `skills`.  An `_id` of the maps comes along.

    A pair counts at the first skill of the prefix that the map holds, so nothing is made
    distinct afterwards.  The rows of a skill meet in a grid of cells of CELL_ROWS postings by
    CELL_HOLDERS maps: a skill of a third of all rows is many tasks, a rare one is one cell
    without copies.
    """
    told = ["_map", "n_holders", *(c for c in maps.columns if c == "_id")]
    right = (
        maps.select("*", F.explode(F.map_keys("skills")).alias("skill_name"))
        .join(rarity, "skill_name")
        .withColumn("_b", _cell(F.col("_map"), "n_profiles", CELL_HOLDERS))
        .select("*", _copies("n_postings", CELL_ROWS).alias("_a"))
        .select("skill_name", "_a", "_b", F.struct("skills").alias("_p"), *told)
    )
    left = (
        probes(links, rarity)
        .withColumn("_a", _cell(F.col("posting_id"), "n_postings", CELL_ROWS))
        .select("*", _copies("n_profiles", CELL_HOLDERS).alias("_b"))
        .select("posting_id", "skills", "skill_name", "earlier", "_a", "_b")
    )
    held = F.map_keys("_p.skills")
    enough = F.size(F.array_intersect("skills", held)) / F.size("skills") >= GOOD_COVERAGE
    met = left.join(right, ["skill_name", "_a", "_b"])
    return met.where(~F.arrays_overlap("earlier", held) & enough).select("posting_id", "skills", "_p", *told)


def _kind(remote: Column, accepted: Column, order: tuple[str, ...]) -> Column:
    """A number for what a profile says of remote work and experience: postings that do not suit it
    are left out for all profiles of a kind at once."""
    n = len(order)
    return F.coalesce(remote.cast("int"), F.lit(2)) * (n + 1) + F.coalesce(accepted, F.lit(n))


def good_matches(
    postings: DataFrame,
    links: DataFrame,
    profiles: DataFrame,
    order: tuple[str, ...] = EXPERIENCE_ORDER,
    top_n: int | None = None,
    shown: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The "good" matches of `matching.match_profiles`, with the profiles as a table.

    `profiles` has the columns of `parameters.read_profiles`; `links` are (posting_id, skill_name).
    A profile without skills, with null skills, or a posting that names none has no good match;
    null ids and names are left out; repeated links count once; profiles of one title each
    give their rows; other columns are not read.  Empty tables give an empty result.  `top_n` keeps
    the best of each title, ties to the lower posting.

    `shown` puts other expressions of `score`, `matched_skills` and `missing_skills` in their place.
    They are worked out once for a posting and a map of skills, not for each match.  Links, maps,
    skills and the scored pairs of postings and maps are stored in the shared folder.
    """
    named = links.where(F.col("posting_id").isNotNull() & F.col("skill_name").isNotNull())
    named = stored(named.select("posting_id", "skill_name").distinct(), "links")
    maps = stored(skill_maps(profiles).withColumn("_id", F.monotonically_increasing_id()), "maps")
    rarity = stored(skill_rarity(named, maps), "skills")
    needed = (
        "posting_id title description salary_from_base salary_to_base is_remote employment_id"
        " experience_id experience_name"
    ).split()
    pairs = with_scores(candidate_pairs(promising(named, rarity), maps, rarity))
    scored = stored(pairs.drop("_p", "_map", "n_holders"), "scored")
    shown = dict(shown or {})
    remote, accepted = F.col("_p_remote_only"), F.col("_accepted")
    held = (
        profiles.select(
            *[F.col(c).alias(f"_p_{c}") for c in _WANTED],
            experience_rank(F.col("max_experience"), order).alias("_accepted"),
            _skill_map().alias("_map"),
        )
        .join(maps.select("_map", "_id"), "_map")
        .drop("_map")
        .withColumn("_kind", _kind(remote, accepted, order))
    )
    kinds = held.groupBy("_id", "_kind").agg(
        F.first(remote).alias("_only"), F.first(accepted).alias("_takes"), F.count(F.lit(1)).alias("n_holders")
    )
    met = scored.groupBy("_id").agg(F.count(F.lit(1)).alias("n_met"))
    kinds = stored(kinds.join(met, "_id"), "kinds")
    no = F.lit(False)
    unfit = F.coalesce(F.col("_only") & ~F.col("is_remote"), no) | F.coalesce(F.col("_needed") > F.col("_takes"), no)
    left = (
        postings.select(*needed, experience_rank(F.col("experience_id"), order).alias("_needed"))
        .join(scored.select("*", *[c.alias(f"_as_{name}") for name, c in shown.items()]), "posting_id")
        .join(kinds, "_id")
        .where(~unfit)
        .withColumn("_a", _cell(F.col("posting_id"), "n_met", CELL_ROWS))
        .select("*", _copies("n_holders", CELL_HOLDERS).alias("_b"))
    )
    one = F.struct(*[f"_p_{c}" for c in _WANTED if c != "skills"])
    right = (
        held.join(kinds.select("_id", "_kind", "n_holders", "n_met"), ["_id", "_kind"])
        .withColumn("_b", _cell(one, "n_holders", CELL_HOLDERS))
        .select("*", _copies("n_met", CELL_ROWS).alias("_a"))
        .drop("n_holders", "n_met")
    )
    # by number: small cells, told by their bytes, would go to few tasks, and hold as many matches
    cell, tasks = ["_id", "_kind", "_a", "_b"], int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *cell), right.repartition(tasks, *cell)
    both = left.join(right, cell)
    both = both.withColumn("_p", F.struct(*[F.col(f"_p_{c}").alias(c) for c in _WANTED]))
    ranks = (F.col("_needed"), F.col("_accepted"))
    found = good_rows(both, order, ranks, [f"_as_{name}" for name in shown])
    if top_n is not None:
        found = top_k_within(found, "profile", [F.desc("score"), F.asc("posting_id")], top_n)
    put = [F.col(f"_as_{c}").alias(c) if c in shown else F.col(c) for c in found.columns if not c.startswith("_as_")]
    return found.select(*put)
