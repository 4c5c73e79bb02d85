"""Vector search, fusion, profile matching, evaluation, windows, statistics."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import market
from tidemark.operators import vectors as v
from tidemark.operators.matching import match_profile, match_profiles
from tidemark.operators.ranking import best_per_parent
from tidemark.operators.windows import bisect_windows
from tidemark.sources.parameters import Profile, as_profile, read_profiles, read_queries
from tidemark.sources.report import report_object, write_report


def rank_frame(spark, rows):
    return spark.createDataFrame([("q", i, r) for i, r in rows.items()], "query_id string, posting_id bigint, rank int")


def scores(df):
    return {r["posting_id"]: r["score"] for r in df.collect()}


def test_rrf_equals_direct_sums(spark):
    """Random rankings of any number and length against the sum of weight / (k + rank)."""
    rng = random.Random(11)
    for n, k in ((1, 60), (2, 7), (4, 0)):
        ranks = [{i: rng.randint(1, 30) for i in rng.sample(range(25), rng.randint(0, 20))} for _ in range(n)]
        weights = [rng.random() for _ in range(n)]
        want = defaultdict(float)
        for weight, rank in zip(weights, ranks):
            for i, r in rank.items():
                want[i] += weight / (k + r)
        got = scores(v.rrf([rank_frame(spark, r) for r in ranks], weights, k=k))
        assert got == pytest.approx(dict(want))
    with pytest.raises(ValueError):
        v.rrf([rank_frame(spark, {1: 1})], [1.0, 2.0])


def test_best_per_parent(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.6), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.8)], "p bigint, i bigint, s double"
    )
    got = {r["p"]: (r["i"], r["s"]) for r in best_per_parent(df, ["p"], "s", "i", ["i", "s"]).collect()}
    assert got == {1: (1, 0.9), 2: (0, 0.8)}


@pytest.fixture(scope="module")
def space(spark):
    """Random chunks, a third of them in one posting, some equal, some without a vector."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(300, 8)).astype("float32")
    vectors[10] = vectors[11] = vectors[12]
    rows = [(0 if i % 3 == 0 else i % 40, i, [float(x) for x in vectors[i]]) for i in range(300)]
    rows += [(5, 900, None)]
    chunks = spark.createDataFrame(rows, "posting_id bigint, chunk_index bigint, embedding array<float>")
    queries = [(f"q{i}", [float(x) for x in vectors[i * 7] + 0.1]) for i in range(5)]
    frame = spark.createDataFrame(queries, "query_id string, embedding array<double>")
    return chunks.repartition(5), frame, rows[:300], queries


def brute_nearest(rows, query):
    q = np.array(query)
    scored = [
        (-round(float(np.array(e) @ q / np.linalg.norm(e) / np.linalg.norm(q)), 9), p, c) for p, c, e in rows
    ]
    return sorted(scored)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_nearest_equals_brute_force(spark, space, block):
    chunks, frame, rows, queries = space
    got = v.nearest_chunks(chunks, frame, 25, block_rows=block).collect()
    for name, vector in queries:
        mine = sorted((r["rank"], r["posting_id"], r["chunk_index"]) for r in got if r["query_id"] == name)
        assert [m[1:] for m in mine] == [b[1:] for b in brute_nearest(rows, vector)[:25]]


def test_semantic_search(spark, space):
    chunks, frame, rows, queries = space
    for exact in (False, True):
        got = v.semantic_search(chunks, frame, 6, 0.2, over_fetch=None if exact else 4).collect()
        for name, vector in queries:
            best = {}
            order = brute_nearest(rows, vector)
            for s, p, c in order if exact else order[:24]:
                if -s >= 0.2:
                    best.setdefault(p, (s, p, c))
            want = [(p, c) for _, p, c in sorted(best.values())][:6]
            mine = sorted((r["rank"], r["posting_id"], r["chunk_index"]) for r in got if r["query_id"] == name)
            assert [m[1:] for m in mine] == want


def test_lists(spark, space):
    chunks, frame, rows, queries = space
    centroids = v.fit_centroids(chunks, 6)
    listed = v.assign_lists(chunks, centroids)
    exact = v.nearest_chunks(chunks, frame, 10).collect()
    assert sorted(map(tuple, v.nearest_chunks(listed, frame, 10, centroids=centroids, nprobe=len(centroids)).collect())) == sorted(map(tuple, exact))
    want = {(r["query_id"], r["chunk_index"]) for r in exact}
    recall = []
    for nprobe in (1, 2, 4, 6):
        near = v.nearest_chunks(listed, frame, 10, centroids=centroids, nprobe=nprobe).collect()
        recall.append(len(want & {(r["query_id"], r["chunk_index"]) for r in near}))
    assert recall == sorted(recall) and recall[-1] == len(want)


def test_stored_lists_are_pruned(spark, space, tmp_path):
    chunks, frame, rows, queries = space
    centroids = v.fit_centroids(chunks, 6)
    listed = v.assign_lists(chunks, centroids)
    v.write_lists(listed, str(tmp_path / "lists"), splits=2)
    stored = spark.read.parquet(str(tmp_path / "lists"))
    assert stored.count() == chunks.count()
    one = frame.limit(1)
    near = v.nearest_chunks(stored, one, 10, centroids=centroids, nprobe=1)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(list_id" in plan or "list_id IN" in plan or "isnotnull(list_id" in plan
    direct = v.nearest_chunks(listed, one, 10, centroids=centroids, nprobe=1)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, direct.collect()))


def test_floors_and_early_output_change_nothing(spark, space, monkeypatch):
    chunks, frame, rows, queries = space
    want = sorted(map(tuple, v.nearest_chunks(chunks, frame, 7).collect()))
    assert sorted(map(tuple, v.nearest_chunks(chunks, frame, 7, floor_one_in=3).collect())) == want
    monkeypatch.setattr(v, "HELD_RECORDS", 1)
    monkeypatch.setattr(v, "PACK_ROWS", 3)
    assert sorted(map(tuple, v.nearest_chunks(chunks, frame, 7, block_rows=2).collect())) == want


def test_floors_keep_rows_in_their_tasks(spark, space, request):
    chunks, frame, rows, queries = space
    # a chunk table this small would be broadcast, and one task would see all of it
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    request.addfinalizer(lambda: spark.conf.unset(threshold))
    spark.conf.set(threshold, "-1")
    asked = frame.withColumn("list_id", F.lit(0)).withColumn("floor", F.lit(None).cast("double"))
    without = v._scored(chunks, asked, 20, False, 512).count()
    near = v.nearest_chunks(chunks.where("chunk_index % 2 = 0"), frame, 20)
    asked = asked.drop("floor").join(v._floors(near, 20), "query_id", "left")
    assert v._scored(chunks, asked, 20, False, 512).count() < without


def test_odd_vectors_and_empty_tables(spark, space):
    chunks, frame, rows, queries = space
    odd = spark.createDataFrame(
        [(1, 1, [float("nan")] + [0.0] * 7), (1, 2, [None] + [0.0] * 7), (1, 3, [0.0] * 8), (None, 4, [1.0] * 8)],
        chunks.schema,
    )
    near = v.nearest_chunks(odd, frame, 5)
    assert {(r["chunk_index"], r["similarity"]) for r in near.collect()} == {(3, 0.0)}
    assert v.nearest_chunks(chunks.limit(0), frame, 5).count() == 0
    assert v.nearest_chunks(chunks, frame.limit(0), 5).count() == 0


def test_planning_runs_no_job(spark, space):
    chunks, frame, rows, queries = space
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    v.semantic_search(chunks, frame, 6)
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("collapse", [False, True])
def test_stop_rule_is_exact_and_leaves_lists_unread(spark, collapse):
    """Tight groups of chunks: far groups cannot hold a better chunk, so they are not read."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16)) * 3
    rows = [
        (i % 50, i, [float(x) for x in middles[i % 12] + rng.normal(size=16) * 0.2]) for i in range(600)
    ]
    chunks = spark.createDataFrame(rows, "posting_id bigint, chunk_index bigint, embedding array<double>")
    asked = [(i, [float(x) for x in middles[i] + 0.1]) for i in range(4)] + [(9, [float(x) for x in rng.normal(size=16)])]
    frame = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    centroids = v.fit_centroids(chunks, 12)
    listed = v.assign_lists(chunks, centroids)
    got = v.stopped_search(
        listed, centroids, v.list_radii(listed, centroids), frame, 5, one_per_posting=collapse
    )
    want = v.nearest_chunks(chunks, frame, 5, one_per_posting=collapse)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    read = {r["query_id"]: (r["lists_read"], r["lists"]) for r in got.collect()}
    assert all(read[q][0] < read[q][1] for q in range(4))


def test_hybrid(spark, space):
    chunks, frame, rows, queries = space
    text = spark.createDataFrame([("q0", 777, 1), ("q0", 0, 2)], "query_id string, posting_id bigint, rank int")
    got = v.hybrid_search(text, chunks, frame, limit=4).where("query_id = 'q0'").orderBy("rank").collect()
    assert got[0]["posting_id"] == 0  # in both lists
    only_text = [r for r in got if r["posting_id"] == 777]
    assert only_text and only_text[0]["similarity"] == 0.0 and only_text[0]["chunk_index"] == -1


# ------------------------------------------------------------------------- matching --

PROFILE = Profile(
    title="p",
    skills={"python": "strong", "n8n": "working", "sql": "basic"},
    missing=("go",),
    salary_min_base=100,
    remote_only=True,
    employment=("full",),
    max_experience="between1And3",
    red_flags=("Office Visits",),
    green_flags=("team",),
)


def posting(**more):
    base = dict(
        posting_id=1, title="Dev", description="text", salary_from_base=150, salary_to_base=None,
        is_remote=True, employment_id="full", experience_id="noExperience", experience_name=None,
        skills=["python", "n8n", "sql"],
    )
    return base | more


_SCHEMA = """posting_id bigint, title string, description string, salary_from_base int, salary_to_base int,
 is_remote boolean, employment_id string, experience_id string, experience_name string, skills array<string>"""


@pytest.mark.parametrize(
    ("change", "verdict", "score", "blockers", "notes"),
    [
        ({}, "good", 0.91, [], []),
        ({"salary_from_base": 50}, "no", 0.91, ["salary_from_low"], []),
        ({"salary_from_base": None, "salary_to_base": 50}, "no", 0.91, ["salary_to_low"], []),
        ({"salary_from_base": None, "salary_to_base": 150}, "good", 0.91, [], []),
        ({"salary_from_base": None}, "good", 0.91, [], ["salary_unknown"]),
        ({"description": "many OFFICE VISITS"}, "no", 0.91, ["red_flag"], []),
        ({"title": "Team dev"}, "good", 0.91, [], ["green_flag"]),
        ({"skills": ["python", "java", "go"]}, "stretch", 0.533, [], ["known_gap"]),
        ({"skills": []}, "stretch", 0.7, [], ["no_skills_named"]),
        ({"is_remote": False}, "no", 0.91, ["not_remote"], []),
        ({"employment_id": "part"}, "no", 0.91, ["employment"], []),
        ({"employment_id": None}, "good", 0.91, [], []),
        ({"experience_id": "moreThan6"}, "no", 0.91, ["experience"], []),
        ({"experience_id": "strange"}, "good", 0.91, [], []),
        ({"description": None}, "good", 0.91, [], []),
    ],
)
def test_match(spark, change, verdict, score, blockers, notes):
    df = spark.createDataFrame([tuple(posting(**change).values())], _SCHEMA)
    row = match_profile(df, PROFILE).first()
    assert row["verdict"] == verdict and row["score"] == pytest.approx(score, abs=5e-4)
    assert [b["code"] for b in row["blockers"]] == blockers
    assert [n["code"] for n in row["notes"]] == notes
    every = ("good", "stretch", "no")
    for p in (PROFILE, Profile(title="open")):
        many = match_profiles(df, [Profile(title="z", skills={"sql": "basic"}), p], verdicts=every)
        same = many.where(F.col("profile") == p.title).drop("profile").first()
        assert same == match_profile(df, p).first()


def test_matches_have_no_join_and_no_shuffle(spark):
    df = spark.createDataFrame([tuple(posting().values())], _SCHEMA)
    both = match_profiles(df, [PROFILE, Profile(title="open")])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r["profile"]: r["verdict"] for r in both.collect()} == {"p": "good", "open": "stretch"}


def test_profiles_file(spark, tmp_path):
    good = {
        "title": "x", "experience_years": 2, "skills": [{"name": "- Docker,", "level": "basic"}, {"name": "docker", "level": "strong"}],
        "missing": ["GO"], "constraints": {"salary_min_base": 5, "remote_only": True},
    }
    (tmp_path / "p.json").write_text(json.dumps([good, {"title": "y"}, good | {"skills": [{"name": "a"}]}]))
    usable, bad = read_profiles(spark, str(tmp_path / "p.json"))
    profile = as_profile(usable.first())
    assert profile.skills == {"docker": "strong"} and profile.missing == ("go",)
    assert profile.remote_only and profile.salary_min_base == 5 and profile.employment == ()
    assert sorted(r["problem"] for r in bad.collect()) == ["a skill lacks its name or level", "experience_years is missing"]


# ----------------------------------------------------------------------- evaluation --


def test_patterns_match_through_their_grams_as_python_matches_them(spark):
    """Random patterns and titles: the join by required words and grams loses no match."""
    rng = random.Random(4)
    say = lambda: " ".join(
        "".join(rng.choices("abAé", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 6))
    )
    titles = {i: say() + rng.choice(["", ".", "+ab", " (a|b)"]) for i in range(300)}
    fixed = [
        "a", "ab b", "a b a b", "(?i)AB é", "aé?b", "a* b+a b", "[ab]{2} a b", "^a b", "b$", "a.b a", r"\(a\|b\)",
        r"\+ab", r"\bab\b", r"\w+ a \w", "a b|b a", "(ab )+", "(?:a|b) a b a", "a{2,}b", "abab", "(?i)É", "", r"a\.",
        r"[^a] b a b", r"\u0061b", "a b?? a", "bb*? a bb", "(?P<x>a) b",
    ]
    patterns = fixed + [re.escape(say()[: rng.randint(1, 12)]) for _ in range(60)]
    queries = spark.createDataFrame(
        [(str(i), [], [p]) for i, p in enumerate(patterns)],
        "query_id string, relevant_ids array<bigint>, patterns array<string>",
    )
    postings = spark.createDataFrame([*titles.items(), (999, None)], "posting_id bigint, title string")
    got = {tuple(r) for r in ev.ground_truth(queries, postings).collect()}
    assert got == {(str(i), j) for i, p in enumerate(patterns) for j, t in titles.items() if re.search(p, t)}
    needs = ev.required_grams(queries).collect()
    assert len(needs) == len(patterns)
    tier = {r.pattern: (r.word, r.gram) for r in needs}
    assert tier["a b a b"] == ("a", None) and tier["(?i)AB é"] == (None, "ab é")
    assert tier["a b|b a"] == tier["(ab )+"] == (None, None) and tier["abab"] == (None, "abab")


def test_patterns_with_grams_make_no_cross_join_and_no_python(spark):
    queries = spark.createDataFrame(
        [("q", [], ["one two three"])], "query_id string, relevant_ids array<bigint>, patterns array<string>"
    )
    postings = spark.createDataFrame([(1, "zero one two three"), (2, "two")], "posting_id bigint, title string")
    found = ev.ground_truth(queries, postings)
    assert [tuple(r) for r in found.collect()] == [("q", 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "NestedLoop" not in plan and "Python" not in plan and "Arrow" not in plan


def test_evaluation(spark, tmp_path):
    (tmp_path / "q.json").write_text(
        json.dumps(
            [
                {"query_id": "a", "query": "qa", "intent": "i", "relevant_ids": [1, 2, 99]},
                {"query_id": "b", "query": "qb", "patterns": ["(?i)бот", "^x+$"]},
                {"query_id": "c", "query": "qc", "patterns": ["never"]},
                {"query_id": "d", "query": "qd"},
            ]
        )
    )
    queries = read_queries(spark, str(tmp_path / "q.json"))
    postings = spark.createDataFrame(
        [(1, "one"), (2, "two"), (3, "Чат-БОТ"), (4, "xxx"), (5, "xy"), (6, None)], "posting_id bigint, title string"
    )
    truth = ev.ground_truth(queries, postings)
    assert {tuple(r) for r in truth.collect()} == {("a", 1), ("a", 2), ("a", 99), ("b", 3), ("b", 4)}

    rankings = spark.createDataFrame(
        [("m", "a", 5, 1), ("m", "a", 1, 2), ("m", "b", 3, 1), ("m", "b", 4, 7), ("m", "c", 1, 1), ("n", "b", 5, 1)],
        "method string, query_id string, posting_id bigint, rank int",
    )
    got = {
        (r["method"], r["metric"], r["k"]): r["value"]
        for r in ev.evaluate_rankings(rankings, truth, queries, ["m", "n", "o"]).collect()
    }
    assert got["m", "recall", 1] == pytest.approx((0 + 1 / 2) / 2)
    assert got["m", "recall", 10] == pytest.approx((1 / 3 + 1) / 2)
    assert got["m", "precision", 5] == pytest.approx((1 / 5 + 1 / 5) / 2)
    assert got["m", "mrr", None] == pytest.approx((1 / 2 + 1) / 2)
    assert (got["m", "evaluated", None], got["m", "skipped", None]) == (2, 2)
    assert got["n", "mrr", None] == got["o", "recall", 5] == 0
    failures = {
        (r["method"], r["query_id"]): r for r in ev.retrieval_failures(rankings, truth, postings, queries, ["m", "n"]).collect()
    }
    assert set(failures) == {("n", "a"), ("n", "b")}
    assert failures["n", "a"]["returned"] is None and failures["n", "a"]["expected"] == 3
    assert [(r["posting_id"], r["title"]) for r in failures["n", "b"]["returned"]] == [(5, "xy")]

    none = ev.evaluate_rankings(rankings, truth.limit(0), queries, ["m"]).collect()
    assert {r["metric"]: r["value"] for r in none}["skipped"] == 4
    assert all(r["value"] == 0 for r in none if r["metric"] != "skipped")


# -------------------------------------------------------------------------- windows --


def recursive_windows(times, start, end, cap, width):
    inside = sum(start <= t < end for t in times)
    if inside == 0:
        return []
    if inside <= cap or end - start <= width:
        return [(start, end, inside, inside > cap)]
    middle = start + timedelta(microseconds=(end - start) // timedelta(microseconds=1) // 2)
    return recursive_windows(times, start, middle, cap, width) + recursive_windows(times, middle, end, cap, width)


@pytest.mark.parametrize(("cap", "hours"), [(3, 1), (50, 24), (1, 7), (1000, 1)])
def test_windows_equal_recursion(spark, cap, hours):
    rng = np.random.default_rng(3)
    start, end = datetime(2026, 1, 1), datetime(2026, 1, 17)  # 384 hours: halves stay whole
    hot = [start + timedelta(hours=100, seconds=int(s)) for s in rng.integers(0, 300, 60)]
    times = [start + timedelta(seconds=int(s)) for s in rng.integers(-9999, 384 * 3600 + 9999, 120)] + hot
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = sorted(
        (r["window_start"], r["window_end"], r["n"], r["over_full"])
        for r in bisect_windows(df, "ts", start, end, cap, timedelta(hours=hours)).collect()
    )
    assert got == sorted(recursive_windows(times, start, end, cap, timedelta(hours=hours)))


def test_windows_of_long_ranges(spark):
    start, end = datetime(1990, 1, 1), datetime(2030, 1, 1)
    df = spark.createDataFrame([(datetime(2026, 5, 5, 5, i),) for i in range(9)], "ts timestamp_ntz")
    rows = bisect_windows(df, "ts", start, end, 3, timedelta(minutes=2)).collect()
    assert sum(r["n"] for r in rows) == 9 and all(r["n"] <= 3 for r in rows)


# ------------------------------------------------------------------------ statistics --


def test_statistics_with_a_hot_skill(spark):
    """A third of all rows in one skill: exact medians, shares of all postings."""
    n = 900
    postings = spark.range(n).select(
        F.col("id").alias("posting_id"),
        F.when(F.col("id") < 600, (F.col("id") * 37 % 501).cast("int")).alias("salary_from_base"),
        (F.col("id") < 300).alias("is_remote"),
        F.when(F.col("id") < 800, F.concat(F.lit("e"), F.col("id").cast("string").substr(1, 1))).alias("experience_id"),
    )
    links = spark.range(n).select(
        F.col("id").alias("posting_id"),
        F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") / 10).cast("int"))).alias("skill_name"),
    )
    skills = links.select("skill_name").distinct().withColumn("display_name", F.upper("skill_name"))
    stats = {r["skill_name"]: r for r in market.skill_stats(postings, links, skills, 5).collect()}
    assert len(stats) == 5 and stats["hot"]["posting_count"] == 300
    assert stats["hot"]["share"] == pytest.approx(1 / 3)
    assert stats["hot"]["median_salary"] == int(np.median([i * 37 % 501 for i in range(300)]))
    totals = market.market_totals(postings).first()
    amounts = [i * 37 % 501 for i in range(600)]
    assert (totals["total"], totals["with_salary"]) == (n, 600)
    assert [totals[f"salary_p{p}"] for p in (25, 50, 75)] == [int(np.percentile(amounts, p)) for p in (25, 50, 75)]
    assert totals["remote_share"] == pytest.approx(1 / 3)
    assert market.by_experience(postings).agg(F.sum("n")).first()[0] == 800
    empty = market.market_totals(postings.limit(0)).first()
    assert tuple(empty) == (0, 0, None, None, None, 0.0)
    assert market.skill_stats(postings.limit(0), links, skills).count() == 0
    # ten first digits, of which e0 is one posting with the amount 0
    assert market.salary_by_experience(postings).count() == 9


def test_percentiles_need_whole_amounts(spark):
    df = spark.createDataFrame([(1.5,)], "salary_from_base double")
    with pytest.raises(TypeError):
        market.amount_counts(df, [])


def test_report(spark, tmp_path):
    frames = {
        "database": spark.createDataFrame([(3, True)], "n int, demo boolean"),
        "top_skills": spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int"),
        "weekly_published": spark.createDataFrame([], "week string, n int"),
    }
    value = json.loads(report_object(frames).first()["value"])
    assert value == {
        "database": {"n": 3, "demo": True},
        "top_skills": [{"name": "b", "n": 2}, {"name": "a", "n": 1}],
        "weekly_published": [],
    }
    write_report(frames, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report/report_json")).first()[0]) == value
