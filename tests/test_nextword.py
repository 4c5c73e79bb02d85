"""Phrases from the pair index against word lists of plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext as ft
from tidemark.operators.nextword import (
    build_pairs,
    frequent_terms,
    phrase_match,
    reading,
    write_pairs,
)

DOC = "posting_id bigint, title string, body string"
VOCABULARY = ["the", "of", "a", "cat", "dog", "hen", "ox"]


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choices(VOCABULARY, [9, 7, 5, 2, 2, 1, 1], k=n))
    rows = [(i, say(rng.randint(0, 4)), say(rng.randint(0, 12))) for i in range(80)]
    return rows + [(80, None, None), (81, "", ""), (82, None, "the"), (83, "the the the", None), (84, "of", "the " * 5_000)]


def test_phrases_are_found_as_in_the_texts(spark, drawn, tmp_path):
    docs = spark.createDataFrame(drawn, DOC)
    index = ft.build_index(docs).cache()
    frequent = frequent_terms(ft.document_frequency(index), one_in=20)
    assert frequent == ["the"]  # 5,000 of its places are in one document
    frequent = ["the", "of", "a"]
    write_pairs(build_pairs(docs.withColumn("at", F.lit("x")), frequent), str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    text = {i: f"{t or ''} {b or ''}".split() for i, t, b in drawn}
    cases = [
        [["of", "the"]], [["the", "the", "the"]], [["cat", "the"]], [["the", "cat", "dog"]], [["cat", "dog", "of"]],
        [["cat", "dog", "hen", "the"]], [["ox"]], [["of", "a"], ["the", "dog"]], [["hen", "ox"], ["the", "of"]],
    ]
    for phrases in cases:
        holds = lambda ws: all(
            any(ws[i : i + len(p)] == p for i in range(len(ws))) for p in phrases  # noqa: B023
        )
        got = sorted(r["posting_id"] for r in phrase_match(pairs, index, phrases, frequent).collect())
        assert got == [i for i, ws in text.items() if holds(ws)], phrases


def test_no_frequent_word_is_read_alone(spark, drawn):
    frequent = {"the", "of", "a"}
    rng = random.Random(4)
    for _ in range(300):
        phrase = rng.choices(VOCABULARY, k=rng.randint(2, 6))
        pairs, alone = reading(phrase, frequent)
        assert not frequent & set(alone.values())
        assert {j for i in pairs for j in (i, i + 1)} | set(alone) == set(range(len(phrase)))
    found = phrase_match(build_pairs(spark.createDataFrame(drawn, DOC), sorted(frequent)), None, [["of", "the"]], frequent)
    assert found.count() > 0
    with pytest.raises(ValueError, match="index of words"):
        phrase_match(found, None, [["cat", "dog"]], frequent)
    with pytest.raises(ValueError, match="nothing"):
        phrase_match(found, None, [], frequent)


def test_no_documents(spark):
    docs = spark.createDataFrame([], DOC)
    pairs = build_pairs(docs, ["the"])
    assert pairs.count() == 0 and phrase_match(pairs, None, [["the", "of"]], ["the"]).count() == 0
    assert frequent_terms(ft.document_frequency(ft.build_index(docs))) == []
