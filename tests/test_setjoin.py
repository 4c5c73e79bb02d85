"""Profiles joined with postings by rare skills, against every pair of them."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import setjoin
from tidemark.operators.matching import match_profiles, with_skills
from tidemark.sources.parameters import Profile

POSTING = """posting_id bigint, title string, description string, salary_from_base int, salary_to_base int,
 is_remote boolean, employment_id string, experience_id string, experience_name string"""
LINK = "posting_id bigint, skill_name string"
PROFILE = """title string, skills map<string,string>, missing array<string>, salary_min_base int,
 remote_only boolean, employment array<string>, max_experience string, red_flags array<string>,
 green_flags array<string>"""


def made(spark, profiles, postings, links):
    rows = [
        (p.title, p.skills, list(p.missing), p.salary_min_base, p.remote_only, list(p.employment),
         p.max_experience, list(p.red_flags), list(p.green_flags)) for p in profiles
    ]
    return (
        spark.createDataFrame(postings, POSTING),
        spark.createDataFrame(links, LINK),
        spark.createDataFrame(rows, PROFILE),
    )


def drawn(seed):
    """Profiles and postings over skills of very unequal frequency."""
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(30)]
    weight = [1 / (i + 1) for i in range(30)]
    pick = lambda k: set(rng.choices(names, weight, k=k))
    profiles = [
        Profile(
            title=f"p{i}",
            skills={s: rng.choice(["strong", "working", "basic", "odd"]) for s in pick(rng.randint(0, 25))},
            salary_min_base=rng.choice([None, 100]),
            remote_only=rng.random() < 0.3,
            red_flags=("boss",) if rng.random() < 0.3 else (),
            missing=tuple(sorted(pick(2))),
        )
        for i in range(25)
    ]
    postings, links = [], []
    for i in range(60):
        postings.append(
            (i, rng.choice(["dev", "big boss", "team"]), rng.choice([None, "text"]), rng.choice([None, 50, 150]),
             rng.choice([None, 80]), rng.random() < 0.6, "full", "noExperience", None)
        )
        links += [(i, s) for s in pick(rng.randint(0, 12))]
    return profiles, postings, links + links[:20]


@pytest.mark.parametrize("cell_rows", [50_000, 3])
def test_good_matches_are_those_of_every_pair(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(setjoin, "CELL_ROWS", cell_rows)
    profiles, postings, links = drawn(7)
    frames = made(spark, profiles, postings, links)
    got = setjoin.good_matches(*frames).collect()
    want = match_profiles(with_skills(frames[0], frames[1]), profiles, verdicts=("good",)).collect()
    assert len(want) > 50
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_prefixes_are_short_and_rarest_first(spark):
    profiles, postings, links = drawn(8)
    _, linked, table = made(spark, profiles, postings, links)
    held = {s: sum(s in p.skills for p in profiles) for s in {s for _, s in links}}
    rows = setjoin.probes(linked, setjoin.skill_rarity(linked, table)).collect()
    for r in rows:
        n = len(r["skills"])
        assert len(r["earlier"]) < n - math.ceil(0.6 * n - 1e-9) + 1
        rest = set(r["skills"]) - set(r["earlier"]) - {r["skill_name"]}
        assert held[r["skill_name"]] > 0
        assert all(held[s] <= held[r["skill_name"]] for s in r["earlier"])
        assert all(held[s] >= held[r["skill_name"]] for s in rest)
    assert len(rows) < len(set(links))


def test_a_hot_skill_is_split_over_cells(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL_ROWS", 10)
    profiles = [Profile(title=f"p{i}", skills={"hot": "strong"}) for i in range(25)]
    postings = [(i, "t", None, None, None, True, "full", "noExperience", None) for i in range(40)]
    frames = made(spark, profiles, postings, [(i, "hot") for i in range(40)])
    found = setjoin.good_matches(*frames)
    assert found.count() == found.select("profile", "posting_id").distinct().count() == 1000
    best = setjoin.good_matches(*frames, top_n=2).groupBy("profile").agg(F.sort_array(F.collect_list("posting_id")).alias("ids"))
    assert all(r["ids"] == [0, 1] for r in best.collect())


def test_odd_and_empty_tables(spark):
    postings = [(1, None, None, None, None, None, None, None, None), (2, "x" * 50_000, "", None, None, True, "f", "?", "n")]
    links = [(1, "a"), (None, "a"), (2, None), (2, "a"), (2, "a")]
    p = [Profile(title="p", skills={"a": "strong"}), Profile(title="p", skills={"a": "strong"}), Profile(title="none")]
    frames = made(spark, p, postings, links)
    odd = spark.createDataFrame([(None,) * 9, ("q", None, None, None, None, None, None, None, None)], PROFILE)
    clash = frames[0].withColumn("skills", F.lit("x")).withColumn("_p", F.lit(1)).withColumn("earlier", F.lit(2))
    got = setjoin.good_matches(clash, frames[1].withColumn("_a", F.lit(9)), frames[2].unionByName(odd))
    keys = sorted((r["profile"], r["posting_id"], r["verdict"]) for r in got.collect())
    assert keys == [("p", 1, "good"), ("p", 1, "good"), ("p", 2, "good"), ("p", 2, "good")]
    for empty in range(3):
        tables = [f.where("false") if i == empty else f for i, f in enumerate(frames)]
        assert setjoin.good_matches(*tables).count() == 0


def test_profiles_of_one_map_of_skills_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL_HOLDERS", 4)
    profiles = [
        Profile(title=f"p{i}", skills={"a": "strong", "b": "basic"}, salary_min_base=10 * i) for i in range(30)
    ]
    postings = [(i, "t", None, 10 * i, None, True, "full", "noExperience", None) for i in range(30)]
    links = [(i, s) for i in range(30) for s in "ab"]
    tables = made(spark, profiles, postings, links)
    maps = setjoin.skill_maps(tables[2])
    assert [r["n_holders"] for r in maps.collect()] == [30]
    assert setjoin.candidate_pairs(tables[1], maps, setjoin.skill_rarity(tables[1], maps)).count() == 30
    got = setjoin.good_matches(*tables).collect()
    want = match_profiles(with_skills(tables[0], tables[1]), profiles, verdicts=("good",)).collect()
    assert len(want) == 30 * 31 // 2
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_only_postings_with_enough_held_skills_are_listed(spark):
    profiles, postings, links = drawn(9)
    _, linked, table = made(spark, profiles, postings, links)
    linked = linked.distinct()
    kept = setjoin.promising(linked, setjoin.skill_rarity(linked, table.limit(3)))
    held = set().union(*(p.skills for p in profiles[:3]))
    own = {i: {s for j, s in links if j == i} for i, _ in links}
    want = {(i, s) for i, names in own.items() if len(names & held) / len(names) >= 0.6 for s in names}
    assert {tuple(r) for r in kept.select("posting_id", "skill_name").collect()} == want
    assert 0 < len(want) < len(set(links))


def test_what_is_shown_is_worked_out_before_the_profiles_meet(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CELL_HOLDERS", 3)
    profiles, postings, links = drawn(10)
    tables = made(spark, profiles, postings, links)
    shown = {"score": F.round("score", 2), "matched_skills": F.array_join("matched_skills", "|")}
    got = setjoin.good_matches(*tables, shown=shown)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, x in enumerate(plan) if "Join Inner" in x) < min(i for i, x in enumerate(plan) if "array_join" in x)
    want = setjoin.good_matches(*tables)
    assert got.columns == want.columns
    want = want.withColumns(shown)
    assert want.count() > 20 and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    best = setjoin.good_matches(*tables, top_n=2, shown=shown)
    assert sorted(map(repr, best.collect())) == sorted(
        map(repr, setjoin.good_matches(*tables, top_n=2).withColumns(shown).collect())
    )
