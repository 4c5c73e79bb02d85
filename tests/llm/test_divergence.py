from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from tidemark.llm import divergence as dv

SF = "/root/testdata/sf0.001"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, min_docs=3, top=200):
    """The contract over (lang, source, text) rows with whole numbers, every pair and term."""
    df, counts, groups = Counter(), {}, {}
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        df.update((lang, w) for w in set(words))
        counts.setdefault((lang, source), Counter()).update(words)
        groups.setdefault(lang, set()).add(source)
    out = set()

    def put(lang, source, part, found, most=None):
        for rank, (item, value) in enumerate(
            sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1
        ):
            out.add((lang, source, part, item, value, rank))

    for lang, sources in groups.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= min_docs]
        own = {s: {w: counts[lang, s][w] for w in kept} for s in sources}
        own[None] = {w: sum(own[s][w] for s in sources) for w in kept}
        p = {}
        for s, c in own.items():
            total = sum(c.values()) + len(kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 1) // total for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            put(lang, s, "pair", {t: sum(f(p[s][w], p[t][w]) for w in kept) for t in sources - {s}})
            leading = {w: f(p[s][w], p[None][w]) for w in kept if own[s][w] and p[s][w] > p[None][w]}
            put(lang, s, "term", leading, top)
    return out


def rows(df):
    got = df.select(*COLUMNS).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def odd_docs():
    rng = random.Random(3)
    words = ["Ab", "ab", "é", "Éa", "x1y", "long" * 20, "ß", "日本", "c", "D", *map(chr, range(97, 123))]
    docs = []
    for _ in range(150):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["a", "b", "Z", "é", None, "日"])
        text = rng.choice(["", None, *(" ".join(rng.choices(words, k=rng.choice([1, 5, 40]))) for _ in range(6))])
        docs += [(lang, source, text)] * rng.choice([1, 1, 3])
    docs += [("only", "one", "few words"), ("bare", "s", "x y"), ("bare", "t", None), ("bare", "u", "1 2 3")]
    return docs


@pytest.fixture(scope="module")
def table(spark):
    full = [(lang, source, text, 1) for lang, source, text in odd_docs()]
    return spark.createDataFrame(full, "lang string, source string, text string, count int").repartition(3)


@pytest.mark.parametrize("shard", [1, 40, 10**6])
def test_equals_plain_sums_in_one_and_many_shards(table, shard):
    assert rows(dv.audit(table, shard_postings=shard)) == brute(odd_docs())


def test_top_and_min_docs(table):
    assert rows(dv.audit(table, min_docs=1, top=2)) == brute(odd_docs(), 1, 2)


def test_small_slices(table, monkeypatch):
    counted = {tuple(r) for r in dv.term_counts(table.fillna("")).collect()}
    monkeypatch.setattr(dv, "COUNT_BYTES", 50)
    assert {tuple(r) for r in dv.term_counts(table.fillna("")).collect()} == counted


def test_sql_equals_operator_on_odd_rows(table):
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    found = con.execute(dv.OP11_SQL)
    names = [c[0] for c in found.description]
    assert {tuple(r[names.index(c)] for c in COLUMNS) for r in found.fetchall()} == brute(odd_docs())


def test_empty_table(table):
    got = dv.audit(table.limit(0))
    assert got.columns == COLUMNS and got.count() == 0


def test_large_counts_stay_exact(spark):
    rng = random.Random(9)
    cases = [(0, 1), (10**12, 10**12 + 5), (7, 9 * 10**15)]
    cases += [(rng.randrange(10**k), 10**k + rng.randrange(10**k)) for k in (3, 9, 12, 15) for _ in range(50)]
    want = [1 + 10**9 * (c + 1) // n for c, n in cases]
    assert dv.probability(*map(np.array, zip(*cases))).tolist() == want
    df = spark.createDataFrame(cases, "c bigint, n bigint").coalesce(1)
    got = df.select(dv.probability_column(df.c, df.n).alias("p")).collect()
    assert [r.p for r in got] == want


def test_op11(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()
    assert rows(dv.op11(spark, SF)) == brute([tuple(r) for r in docs])
