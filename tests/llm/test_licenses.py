from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import licenses

LISTS = st.lists(st.integers(0, 6), max_size=25)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(a=LISTS, b=LISTS)
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    assert len(pairs) <= lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(12)), st.permutations(range(12)))
def test_unique_words_give_the_longest(a, b):
    pairs = [(i, b.index(x)) for i, x in enumerate(a)]
    assert len(licenses._rising(pairs)) == lcs(a, b)
    assert licenses.align(a, a) == [(i, i) for i in range(12)]


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_planted_licenses(make_docs):
    rng = random.Random(1)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        if len(words) > 10:  # a word of ten is lost, another comes in
            words = [w for k, w in enumerate(words) if k % 10 != 4]
            words.insert(7, "something")
        rows.append((i, say(rng, 50) + "\n" + " ".join(words).upper() + "\n" + say(rng, 40)))
        want[i] = name
    twice = licenses.TEMPLATES[0][1] + " " + licenses.TEMPLATES[0][1] + "\n" + licenses.TEMPLATES[5][1]
    rows += [(20, twice), (21, None), (22, ""), (23, say(rng, 20_000) + " All rights reserved."),
             (24, "all of us " + say(rng, 40) + " rights " + say(rng, 40) + " reserved"),
             (25, "rights all reserved"), (1, rows[1][1]), (None, "Released under the MIT license")]
    docs = make_docs(rows).withColumnRenamed("lang", "row").withColumnRenamed("source", "out")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.row.doc_id: r.out for r in got}
    for i, name in want.items():
        assert name in [m.license for m in by[i]]
        m = next(m for m in by[i] if m.license == name)
        assert m.coverage >= 0.8 and 50 <= m.first_word <= m.last_word < len(re.findall(r"\w+", rows[i][1])) - 39
    assert {m.license: m.coverage for m in by[20]} == {"Apache-2.0": 1.0, "MIT": 1.0}
    assert [m.license for m in by[None]] == ["MIT"] and [m.license for m in by[23]] == ["proprietary"]
    assert not by[21] and not by[22] and not by[24] and not by[25]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert all(not r.out for r in licenses.scan(docs, [("x", "!!!"), ("y", "")]).collect())


def test_query_finds_whole_lines(spark, small):
    got = {r.doc_id: r for r in licenses.op9(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    short = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) < 14]
    for d in docs:
        for name, line in short:
            if line in d.text.split("\n"):
                assert name in got[d.doc_id].licenses.split(",") and got[d.doc_id].coverage == 1.0
        if got[d.doc_id].n_licenses:
            text = d.text.lower()
            assert "licensed" in text or "license" in text or "rights" in text
