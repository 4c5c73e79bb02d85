"""Text preparation and full-text search against plain expectations."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import fulltext as ft
from tidemark.operators.chunking import _folded_pieces, _pieces, chunk_documents, sentences
from tidemark.operators.embedding import hash_vector, mixed_models, refresh_chunks
from tidemark.operators.html import extract_text
from tidemark.operators.stem import stem_forms, stem_index
from tidemark.plans import text as text_plans
from tidemark.schemas import CHUNKS


def texts(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(list(enumerate(rows)), schema)


# ---------------------------------------------------------------------------- HTML --


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>Tasks:</p><ul><li>one&nbsp;&amp;&nbsp;two</li><li>three</li></ul>", "Tasks:\n\n— one & two\n\n— three"),
        ("a<br/>b", "a\nb"),
        ("<p></p><p></p><p>x</p><p></p>y", "x\n\ny"),
        ("twice &amp;lt;b&amp;gt;", "twice <b>"),
        ("<b>in</b><i>line</i> <!-- gone --> text", "inline text"),
        ("<script>var t='</p>';</script>x", "var t='</p>';x"),
        ("  \n ", ""),
        (None, ""),
        ("a \t  b \n   c", "a b\nc"),
        ("1 < 2 &copy;", "1 < 2 ©"),
    ],
)
def test_extract_text(spark, html, want):
    df = spark.createDataFrame([(html,)], "html string")
    assert extract_text(df).first()["text"] == want


# -------------------------------------------------------------------------- chunks --


def expected_chunks(text: str, budget: int, overlap: int) -> list[str]:
    """Chunks by positions in the sentence list, an independent formulation."""
    units: list[tuple[str, bool]] = []
    for line in text.split("\n"):
        for s in filter(None, (p.strip() for p in re.split(r"(?<=[.!?…])\s+", line.strip()))):
            if len(s) <= budget:
                units.append((s, False))
                continue
            words, start = s.split(), 0
            while start < len(words):
                end = start + 1
                while end < len(words) and len(" ".join(words[start : end + 1])) <= budget:
                    end += 1
                units.append((" ".join(words[start:end]), True))
                start = end
    out, first = [], 0
    for i, (unit, alone) in enumerate(units):
        if alone:
            if first < i:
                out.append(units[first:i])
            out.append([units[i]])
            first = i + 1
        elif first < i and len(" ".join(u for u, _ in units[first : i + 1])) > budget:
            out.append(units[first:i])
            start = i
            while start > first and sum(len(u) + 1 for u, _ in units[start:i]) < overlap:
                start -= 1
            first = start if overlap > 0 else i
    if first < len(units):
        out.append(units[first:])
    return [" ".join(u for u, _ in chunk) for chunk in out]


def check_chunks(spark, rows, budget, overlap):
    got = defaultdict(list)
    for r in chunk_documents(texts(spark, rows), "doc_id", "text", budget, overlap).collect():
        assert r["char_len"] == len(r["content"])
        got[r["doc_id"]].append((r["chunk_index"], r["content"]))
    for i, text in enumerate(rows):
        want = expected_chunks(text, budget, overlap)
        assert [c for _, c in sorted(got[i])] == want
        assert [n for n, _ in sorted(got[i])] == list(range(len(want)))


def test_chunk_cases(spark):
    rows = [
        " ".join(f"Sentence number {i} is here." for i in range(19)),
        "word " * 60,
        "x" * 500,
        "Short. " + "y" * 130 + " z. Tail one. Tail two.",
        "",
        "   \n  ",
        "a\n\n\nb. c! d? e… f",
    ]
    for budget, overlap in ((150, 30), (100, 10), (60, 0), (40, 100), (1, 5)):
        check_chunks(spark, rows, budget, overlap)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(st.text(alphabet="ab. !\né…", max_size=200), min_size=20, max_size=20),
    budget=st.integers(5, 60),
    overlap=st.integers(0, 30),
)
def test_chunk_random_texts(spark, rows, budget, overlap):
    check_chunks(spark, rows, budget, overlap)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(st.text(alphabet="ab\U0001f600 \t\xa0\u2028", max_size=60), min_size=60, max_size=60),
    budget=st.integers(1, 12),
)
def test_pieces_by_pattern_are_those_of_the_fold(spark, rows, budget):
    df = texts(spark, [r.strip() or "a" for r in rows]).withColumn("budget", F.lit(budget))
    c, b = F.col("text"), F.col("budget")
    for r in df.select("text", _pieces(c, b).alias("got"), _folded_pieces(c, b).alias("want")).collect():
        assert r["got"] == r["want"], (r["text"], budget)


def test_chunks_of_texts_of_many_strides(spark):
    """Texts of 80,000 words: sentences beyond a stride, and one sentence without an end."""
    spoken = " ".join(f"Word {i} ends here." if i % 7 else "x" * 70 for i in range(20_000))
    check_chunks(spark, [spoken, "ab cde " * 40_000, ". ".join("abcdefg"[: i % 7 + 1] for i in range(257))], 60, 20)


def test_chunk_whole_documents(spark, sf):
    docs = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    check_chunks(spark, docs, 900, 150)


def test_title_prefix(spark):
    df = spark.createDataFrame([(1, "Title", "One two. " * 10)], "id bigint, title string, text string")
    rows = chunk_documents(df, "id", "text", 40, 10, title_col="title").collect()
    assert len(rows) > 1 and all(r["content"].startswith("Title\n") for r in rows)
    bodies = expected_chunks("One two. " * 10, 40 - len("Title\n"), 10)
    assert [r["content"] for r in rows] == ["Title\n" + b for b in bodies]


def test_sentences(spark):
    df = texts(spark, ["One. Two! three\n\n four… five.six "]).select(sentences(F.col("text")).alias("s"))
    assert df.first()["s"] == ["One.", "Two!", "three", "four…", "five.six"]


# ------------------------------------------------------------------------- vectors --


def test_hash_vector():
    a = hash_vector("Python developer, python tools")
    assert len(a) == 384 and abs(a @ a - 1) < 1e-9
    assert (a == hash_vector("python PYTHON tools developer")).all()
    assert a @ hash_vector("python tools") > a @ hash_vector("hotel manager wanted")
    assert not hash_vector(" ,. ").any()


def test_refresh_chunks_runs(spark):
    postings = spark.createDataFrame(
        [
            (1, "A", "<p>Some text. More text.</p>"),
            (2, "B", ""),
            (3, "C", None),
            (4, "D", "<p> </p>"),
            (5, "E", "<p>Other words here.</p>"),
        ],
        "posting_id bigint, title string, description string",
    )
    empty = spark.createDataFrame([], CHUNKS)
    table, counts = refresh_chunks(postings, empty)
    assert tuple(counts.first()) == (3, 2, 0)  # the text of 4 is blank, yet it was looked at
    again, counts = refresh_chunks(postings, table)
    assert tuple(counts.first()) == (1, 0, 2)
    assert again.count() == table.count() == 2
    assert mixed_models(again).count() == 0
    # another model replaces all chunks
    other, counts = refresh_chunks(postings, table, model="second")
    assert tuple(counts.first()) == (3, 2, 0)
    assert {r["model_name"] for r in other.collect()} == {"second"}
    forced, counts = refresh_chunks(postings, table, only_missing=False)
    assert tuple(counts.first()) == (3, 2, 0) and forced.count() == 2
    limited, counts = refresh_chunks(postings, empty, limit=1)
    assert [r["posting_id"] for r in limited.collect()] == [1]
    assert all(r["content"].startswith(("A\n", "E\n")) for r in table.collect())


# --------------------------------------------------------------------------- search --

DOCS = [
    ("red fox", "the quick red fox jumps over the lazy dog"),
    ("dog days", "a fox and a dog and a fox"),
    ("blue", "nothing to see, quick brown"),
    ("fox", None),
    (None, "dog fox"),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(
        [(i, *d) for i, d in enumerate(DOCS)], "posting_id bigint, title string, body string"
    )
    return ft.build_index(docs).cache()


def ids(df):
    return sorted(r["posting_id"] for r in df.collect())


def test_match(spark, index):
    assert ids(ft.text_match(index, ["fox", "dog"])) == [0, 1, 4]
    assert ids(ft.text_match(index, ["fox"], none_of=["dog"])) == [3]
    assert ids(ft.text_match(index, any_of=["blue", "days"])) == [1, 2]
    assert ids(ft.text_match(index, phrases=[["lazy", "dog"]])) == [0]
    assert ids(ft.text_match(index, phrases=[["dog", "fox"]])) == [4]
    assert ids(ft.text_match(index, ["quick"], phrases=[["red", "fox"], ["the", "lazy"]])) == [0]
    universe = spark.range(5).withColumnRenamed("id", "posting_id")
    assert ids(ft.text_match(index, none_of=["fox"], universe=universe)) == [2]
    with pytest.raises(ValueError):
        ft.text_match(index, none_of=["fox"])


def brute_rank(title, body, terms):
    """Covers by trying all stretches."""
    def cut(text):
        return re.findall(r"\w+", (text or "").lower())
    words = [(w, 1.0) for w in cut(title)] + [(w, 0.4) for w in cut(body)]
    n = len(terms)
    full = [
        (b, e)
        for b, e in combinations(range(len(words) + 1), 2)
        if set(terms) <= {w for w, _ in words[b:e]}
    ]
    minimal = [
        (b, e) for b, e in full if not any((x, y) != (b, e) and b <= x and y <= e for x, y in full)
    ]
    score = 0.0
    for b, e in minimal:
        last = {w: weight for w, weight in words[b:e] if w in terms}
        score += sum(last.values()) / n / (1 + (e - b - n))
    return round(score, 9)


def test_rank_equals_brute_force(spark, index):
    queries = {"1": ["fox"], "2": ["fox", "dog"], "3": ["the", "fox", "quick"], "4": ["a", "fox", "dog", "and"]}
    got = {(r["query_id"], r["posting_id"]): r["rank"] for r in ft.text_rank(index, queries).collect()}
    want = {
        (q, i): rank
        for q, terms in queries.items()
        for i, (title, body) in enumerate(DOCS)
        if (rank := brute_rank(title, body, terms))
    }
    assert got == pytest.approx(want)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(st.lists(st.sampled_from("abcx"), max_size=12), min_size=10, max_size=10))
def test_rank_random_documents(spark, docs):
    frame = spark.createDataFrame(
        [(i, " ".join(d[:3]), " ".join(d[3:])) for i, d in enumerate(docs)],
        "posting_id bigint, title string, body string",
    )
    got = {r["posting_id"]: r["rank"] for r in ft.text_rank(ft.build_index(frame), {"q": ["a", "b", "c"]}).collect()}
    want = {
        i: rank
        for i, d in enumerate(docs)
        if (rank := brute_rank(" ".join(d[:3]), " ".join(d[3:]), ["a", "b", "c"]))
    }
    assert got == pytest.approx(want)


def test_search_orders_and_filters(spark, index):
    postings = spark.createDataFrame(
        [(i, f"t{i}", 7 if i else None, 100 * i if i else None, i % 2 == 0, f"2026-01-0{i + 1}", "e1") for i in range(5)],
        "posting_id bigint, title string, employer_id bigint, salary_from_base int, is_remote boolean, d string, experience_id string",
    ).withColumn("published_at", F.col("d").cast("timestamp")).drop("d")
    employers = spark.createDataFrame([(7, "Firm")], "employer_id bigint, employer_name string")

    def search(*args, **more):
        return [r["posting_id"] for r in ft.search_postings(postings, employers, index, *args, **more).collect()]

    assert search() == [4, 3, 2, 1, 0]
    assert search("   ") == [4, 3, 2, 1, 0]
    assert search(limit=0) == [4]
    assert search(limit=2, offset=1) == [3, 2]
    assert search(offset=-4, limit=99) == [4, 3, 2, 1, 0]
    assert search(salary_min=200) == [4, 3, 2]
    assert search(salary_min=1) == [4, 3, 2, 1]  # an unknown salary drops out
    assert search(experience_ids=[]) == [4, 3, 2, 1, 0]
    assert search(experience_ids=["e2"]) == []
    assert search(remote_only=True) == [4, 2, 0]
    assert search(within_days=2, now=F.lit("2026-01-05").cast("timestamp")) == [4, 3, 2]
    assert set(search("fox")) == {0, 1, 3, 4}
    both = sorted((0, 1, 4), key=lambda i: -brute_rank(*DOCS[i], ["fox", "dog"]))
    assert search("Fox, dog!") == both
    assert search("fox", none_of=["dog"]) == [3]
    assert search(none_of=["fox"]) == [2]
    assert set(search(any_of=["blue", "days"])) == {1, 2}
    top = ft.search_postings(postings, employers, index, "fox dog").collect()
    assert {r["posting_id"]: r["employer_name"] for r in top} == {0: None, 1: "Firm", 4: "Firm"}
    assert ft.search_postings(postings, employers).first()["rank"] is None


def test_search_plan_is_top_k(spark, index, capsys):
    postings = index.select("posting_id").distinct().withColumn("published_at", F.lit("2026-01-01").cast("timestamp"))
    ft.search_postings(
        postings.withColumn("employer_id", F.lit(1)), None, index, "fox", columns=["posting_id", "rank"]
    ).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


def test_stems(spark):
    docs = spark.createDataFrame(
        [(1, "Walking", "tours"), (2, "x", "he walks a tour"), (3, "walker", "of the dog")],
        "posting_id bigint, title string, body string",
    )
    rows = ft.build_index(docs)
    pairs = [("walking", "walk"), ("walks", "walk"), ("tours", "tour"), ("tour", "tour"), ("he", "he")]
    vocabulary = spark.createDataFrame(pairs, "term string, stem string")
    forms = stem_forms(vocabulary, ["walks", "tour", "unheard"])
    assert forms == {"walking": "walk", "walks": "walk", "tours": "tour", "tour": "tour", "unheard": "unheard"}
    assert ids(ft.text_match(stem_index(rows, vocabulary, forms), ["walk", "tour"])) == [1, 2]
    assert ids(ft.text_match(stem_index(rows, vocabulary), ["he", "walk"])) == [2]
    plan = stem_index(rows, vocabulary, forms)._jdf.queryExecution().toString()
    assert "Join" not in plan
    postings = docs.select("posting_id", F.lit("2026-01-01").cast("timestamp").alias("published_at"))

    def search(text, **more):
        hits = ft.search_postings(postings, None, rows, text, columns=["posting_id"], **more)
        return [r["posting_id"] for r in hits.collect()]

    assert search("walking") == [1]
    assert search("the walks", vocabulary=vocabulary) == [1, 2]
    assert search("he walks", vocabulary=vocabulary, stop_words=frozenset()) == [2]
    assert search("unheard", vocabulary=vocabulary) == [] and search("the") == []


def test_index_runs_inside_the_row(spark):
    docs = spark.createDataFrame(
        [(1, "B a b", "b A"), (2, None, None), (3, "", "x"), (4, "one", "")],
        "posting_id bigint, title string, body string",
    )
    rows = ft.build_index(docs)
    got = sorted((r.posting_id, r.term, r.field, list(r.positions)) for r in rows.collect())
    assert got == [
        (1, "a", "A", [1]), (1, "a", "B", [4]), (1, "b", "A", [0, 2]), (1, "b", "B", [3]),
        (3, "x", "B", [0]), (4, "one", "A", [0]),
    ]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_deep_search_returns_as_many_rows_as_asked(spark):
    docs = spark.range(300).select(
        F.col("id").alias("posting_id"), F.lit("word").alias("title"), F.lit("").alias("body"),
        F.lit("2026-01-01").cast("timestamp").alias("published_at"),
    )
    found = ft.search_postings(docs, None, ft.build_index(docs), "word", limit=200, columns=["posting_id"])
    assert found.count() == 200


def test_stored_index_prunes_by_term(spark, index, tmp_path):
    ft.write_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert ids(ft.text_match(stored, ["fox", "dog"])) == [0, 1, 4]
    plan = ft.text_match(stored, ["fox"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,fox)]" in plan or "In(term" in plan or "term,fox" in plan


def test_markup_is_read_in_parts_of_few_bytes(spark):
    import pyarrow as pa

    from tidemark.operators import html

    rows = [None, "", "x" * (html.SLICE_BYTES + 1)] + ["<p>ä</p>"] * 1000 + ["y" * 300_000] * 20 + [None]
    parts = list(html.slices(pa.array(rows, pa.string())))
    assert [t for p in parts for t in p.to_pylist()] == rows
    assert all(len(p) <= html.SLICE_ROWS and (len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= html.SLICE_BYTES) for p in parts)
    assert list(html.slices(pa.array([], pa.string()))) == []
    table = spark.createDataFrame(list(enumerate(rows)), "i int, html string").coalesce(1)
    got = [r["text"] for r in html.extract_text(table).orderBy("i").collect()]
    assert got == ["" if t is None else t.replace("<p>", "").replace("</p>", "") for t in rows]


# --------------------------------------------------------------- queries over documents --


def documents(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunk_invariants_chunk_once(spark, tmp_path):
    long = " ".join(f"Word{i} goes on\there." for i in range(60))
    rows = [(1, long, "en"), (2, "one  two one", "en"), (2, "two\n three.", "de"), (None, "no id", "en"),
            (3, " \n ", "en"), (4, None, "en"), (5, long + " " + long, None)]
    out = text_plans.chunk_invariants(spark, documents(spark, tmp_path, rows))
    assert plan_of(out).count("FileScan") == 1
    # two texts of one id number their chunks twice: 0 + 1 is not 2
    assert {tuple(r) for r in out.collect()} == {(1, 63, True), (2, 3, False), (5, 63, True)}


def test_refreshed_index_moves_no_words(spark, tmp_path):
    rows = [(1, "the cat\nsat on the mat", "en"), (2, "der hund", "de"), (3, "the\nthe", "en"), (3, "la the", "fr"),
            (4, None, "de"), (5, "", "en"), (6, "the end", None)]
    folder = documents(spark, tmp_path, rows)
    name = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(name)
    try:
        spark.conf.set(name, "-1")  # as for tables that are not small
        out = text_plans.refreshed(spark, folder)
        plan = plan_of(out)
    finally:
        spark.conf.set(name, usual)
    want = {"the": (2, 5), "cat": (1, 1), "sat": (1, 1), "on": (1, 1), "mat": (1, 1), "der": (1, 1),
            "hund": (1, 1), "la": (1, 1)}
    assert {r["term"]: (r["documents"], r["occurrences"]) for r in out.collect()} == want
    assert "SortMergeJoin" not in plan
    above = plan[: plan.index("_r#")]  # nothing is moved between the words and the joins
    assert above.count("Exchange") == 1
