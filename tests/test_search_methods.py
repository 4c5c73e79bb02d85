"""The text, semantic and hybrid searches judged on whole query texts, against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import fulltext as ft
from tidemark.operators.embedding import hash_embedding, hash_vector
from tidemark.operators.letters import LETTERS, letter_counts

LIMIT, WEIGHT = 3, 0.4
WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty".split()


@pytest.fixture(scope="module")
def corpus(spark):
    """Forty documents of two lines; every query but the odd ones is a line of some document."""
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = {i: (line(4), line(9)) for i in range(40)}
    docs[40] = docs[41] = docs[3]
    docs[42] = ("", "")
    queries = {f"q{i}": docs[i * 5][1] for i in range(6)}
    queries |= {"unknown": "amber quartz", "empty": "", "null": None, "twice": "delta delta ember"}
    return docs, queries


@pytest.fixture(scope="module")
def found(spark, corpus):
    docs, queries = corpus
    texts = spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "posting_id bigint, title string, body string")
    lines = [(i, at, text) for i, pair in docs.items() for at, text in enumerate(pair)]
    chunks = spark.createDataFrame(lines, "posting_id bigint, chunk_index bigint, text string")
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    rows = ev.method_rankings(
        ft.build_index(texts),
        chunks.withColumn("embedding", hash_embedding(F.col("text"))),
        asked,
        asked.select("query_id", hash_embedding(F.col("query")).alias("embedding")),
        LIMIT,
        WEIGHT,
    )
    out = defaultdict(dict)
    for r in rows.collect():
        out[r["method"], r["query_id"]][r["rank"]] = r["posting_id"]
    return {key: [ranks[i] for i in sorted(ranks)] for key, ranks in out.items()}


def text_list(docs, query):
    """Documents with all words, by the sum over minimal covers."""
    asked = sorted(set(re.findall(r"\w+", query or "")))
    scored = []
    for i, (title, body) in docs.items():
        head = title.split()
        places = [(w, 1.0 if at < len(head) else 0.4) for at, w in enumerate(head + body.split())]
        if not asked or not set(asked) <= {w for w, _ in places}:
            continue
        spans = [
            (b, e)
            for b in range(len(places))
            for e in range(b, len(places))
            if set(asked) <= {w for w, _ in places[b : e + 1]}
        ]
        minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
        score = 0.0
        for b, e in minimal:
            last = {w: x for w, x in places[b : e + 1]}
            score += sum(last[w] for w in asked) / len(asked) / (1 + e - b + 1 - len(asked))
        scored.append((-round(score, 9), i))
    return [i for _, i in sorted(scored)]


def near_list(docs, query):
    if query is None:
        return []
    q = hash_vector(query).astype("float32").astype(float)
    q = q / (np.linalg.norm(q) or 1)
    best = {}
    for i, pair in docs.items():
        for at, text in enumerate(pair):
            x = hash_vector(text).astype("float32").astype(float)
            s = round(float(x / (np.linalg.norm(x) or 1) @ q), 12)
            best[i] = min(best.get(i, (9, 9, 9)), (-s, i, at))
    return [i for s, i, _ in sorted(best.values()) if s <= 0]


def test_searches_equal_plain_python(corpus, found):
    docs, queries = corpus
    for name, query in queries.items():
        text, near = text_list(docs, query)[: 4 * LIMIT], near_list(docs, query)[: 4 * LIMIT]
        assert found.get(("text", name), []) == text[:LIMIT], name
        assert found.get(("semantic", name), []) == near[:LIMIT], name
        score = defaultdict(float)
        for weight, listed in ((WEIGHT, near), (1 - WEIGHT, text)):
            for at, i in enumerate(listed, 1):
                score[i] += weight / (60 + at)
        place = {i: at for at, i in enumerate(near)}
        fused = sorted(score, key=lambda i: (-round(score[i], 12), place.get(i, 10**6), i))
        assert found.get(("hybrid", name), []) == fused[:LIMIT], name


def test_metrics_of_the_searches(spark, corpus, found):
    """Explicit ids count as they are, patterns only where there are none; the rest is skipped."""
    docs, queries = corpus
    rows = [(m, q, i, at) for (m, q), listed in found.items() for at, i in enumerate(listed, 1)]
    rankings = spark.createDataFrame(rows, "method string, query_id string, posting_id bigint, rank int")
    relevant = {"q0": [0], "q1": [5, 77], "twice": []}
    labelled = spark.createDataFrame(
        [(q, t, "", relevant.get(q, []), ["cedar"] if q == "q1" else []) for q, t in queries.items()],
        "query_id string, query string, intent string, relevant_ids array<bigint>, patterns array<string>",
    )
    titles = spark.createDataFrame([(i, a) for i, (a, _) in docs.items()], "posting_id bigint, title string")
    truth = ev.ground_truth(labelled, titles)
    assert sorted(map(tuple, truth.collect())) == [("q0", 0), ("q1", 5), ("q1", 77)]
    got = {
        (r["method"], r["metric"], r["k"]): r["value"]
        for r in ev.evaluate_rankings(rankings, truth, labelled, ev.SEARCHES, (1, 3)).collect()
    }
    for method in ev.SEARCHES:
        shares = [
            len(set(found.get((method, q), [])[:3]) & set(relevant[q])) / len(relevant[q]) for q in ("q0", "q1")
        ]
        assert got[method, "recall", 3] == pytest.approx(sum(shares) / 2)
        assert (got[method, "evaluated", None], got[method, "skipped", None]) == (2, len(queries) - 2)


def test_long_queries_look_up_documents_with_their_rarest_word_only(spark):
    docs = [(i, "the of and", "in a" + (" rare word" if i % 50 == 0 else "")) for i in range(200)]
    index = ft.build_index(spark.createDataFrame(docs, "posting_id bigint, title string, body string"))
    terms = ft.query_terms(
        spark, {"q": ["the", "of", "rare", "in", "and"], "all": ["the", "a"], "none": ["the", "absent"]}
    )
    found = ft.candidate_documents(index, terms)
    assert {(r[0], r[1]) for r in found.collect() if r[0] != "all"} == {("q", i) for i in range(0, 200, 50)}
    want = sorted(map(tuple, ft.rank_terms(index, terms).collect()))
    assert len(want) == 204
    assert sorted(map(tuple, ft.rank_long_queries(index, terms).collect())) == want


def test_an_index_is_built_without_sorting_rows_one_by_one(spark, monkeypatch):
    """Any number of documents a slice gives the same rows, whose order of places holds."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice([*WORDS, "Ä_1", "Λόγος", "…"]) for _ in range(n))
    docs = [(f"d{i}", text(rng.randint(0, 3)), text(rng.randint(0, 40))) for i in range(30)]
    docs += [docs[0], (None, "amber", "amber delta"), ("none", None, None), ("title", "delta", None), ("body", None, "Delta, delta")]
    rows = spark.createDataFrame(docs, "posting_id string, title string, body string").coalesce(2)
    want = []
    for key, *fields in docs:
        found, at = defaultdict(list), 0
        for name, field in zip("AB", fields):
            for word in re.findall(r"\w+", (field or "").lower()):
                found[word, name].append(at)
                at += 1
        want += [(w, key, name, places) for (w, name), places in found.items()]
    plan = ft.build_index(rows, in_batches=True)._jdf.queryExecution().toString()
    assert "sort_array" not in plan and "MapInArrow" in plan
    for words_ in (ft.SLICE_WORDS, 1, 50):
        monkeypatch.setattr(ft, "SLICE_WORDS", words_)
        index = ft.build_index(rows, in_batches=True)
        assert index.dtypes == ft.build_index(rows).dtypes
        assert sorted(map(repr, map(tuple, index.collect()))) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, ft.build_index(rows).collect()))) == sorted(map(repr, want))
    assert ft.build_index(rows.where("false"), in_batches=True).count() == 0


def test_letters_are_counted_in_one_pass(spark):
    texts = ["", None, "abc ABC z", "Łódź – ñandúK", "123", "x" * 5000, "\n", *(c * 3 for c in LETTERS)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    made = rows.select("i", letter_counts(F.col("text")).alias("v"))
    plan = made.where(F.col("v").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("ArrowEvalPython") == 1
    got = dict(map(tuple, made.collect()))
    for i, text in enumerate(texts):
        counts = [float(sum(text.count(x) for x in (c, c.upper()))) for c in LETTERS] if text else [0.0]
        assert got[i] == (counts if any(counts) else None), text


def test_positions_are_looked_up_where_the_candidates_are(spark, monkeypatch):
    """The few candidates and rarest words are stored, so that the words of all texts are not dealt out for them."""
    labels, kept = [], ft.stored
    monkeypatch.setattr(ft, "stored", lambda df, label: labels.append(label) or kept(df, label))
    docs = [(i, "the", f"word{i} of") for i in range(50)] + [(None, "the", "word1")]
    index = ft.build_index(spark.createDataFrame(docs, "posting_id bigint, title string, body string"))
    terms = ft.query_terms(spark, {"q": ["the", "word1"], "none": ["the", "absent"]})
    found = ft.rank_long_queries(index, terms)
    assert labels == ["query-words", "rarest-words", "candidates"]
    assert [tuple(r)[:2] for r in found.collect()] == [("q", 1)]
    assert "LeftSemi" in found._jdf.queryExecution().toString()
