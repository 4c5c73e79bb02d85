from __future__ import annotations

import random
import re

import numpy as np
from tidemark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        have, hit, names = words(text), set(), set()
        for name, item in items:
            want = words(item)
            if name is None or not want:
                continue
            n = min(window, len(want))
            for i in range(len(want) - n + 1):
                for j in range(len(have) - n + 1):
                    if have[j : j + n] == want[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add(str(name))
        out.append((doc_id, len(have), len(hit), tuple(sorted(names))))
    return sorted(out, key=repr)


def got(found):
    rows = found.select("row.doc_id", "found.*").collect()
    return sorted(
        [(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in rows], key=repr
    ), rows


def test_an_id_of_several_texts_is_listed_once_however_items_are_cut(spark, make_docs):
    items = [("a", "one two three"), ("a", "four five six"), ("b", "one two three"), ("c", "seven")]
    texts = [(1, "one two three four five six"), (2, "four five six"), (3, "eight")]
    table = spark.createDataFrame(items, "item_id string, text string")
    want = [(1, 6, 6, ("a", "b")), (2, 3, 3, ("a",)), (3, 1, 0, ())]
    assert brute(texts, items) == want
    for limit in (8_000_000, 14, 1):
        assert got(d.find_matches(make_docs(texts), table, block_bytes=limit))[0] == want


def test_matches_equal_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    vocab = ["a", "B", "c", "é", "7", "it"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [(i, say(rng.randint(0, 60))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "-- !"), (None, texts[3][1]), (3, texts[3][1])]
    texts += [(103, say(4000))]
    items = [(i, say(rng.randint(3, 8))) for i in range(12)]
    items += [(50, None), (51, ""), (None, "a b"), (52, items[0][1]), (9, "Nowhere at all")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for limit in (8_000_000, 20):  # one block, many blocks
        found = d.find_matches(make_docs(texts), table, window=4, block_bytes=limit)
        mine, rows = got(found)
        assert mine == brute(texts, items, 4)
        for r in rows:
            have = words(next(t for i, t in texts if i == r.doc_id))
            for m in r.matches:
                want = words(next(t for i, t in items if str(i) == m.item_id))
                piece = want[m.item_word : m.item_word + m.n_words]
                assert have[m.doc_word : m.doc_word + m.n_words] == piece
                left = m.item_word and m.doc_word
                assert not left or want[m.item_word - 1] != have[m.doc_word - 1]


def test_production_window(spark, make_docs):
    item = " ".join(f"w{i}" for i in range(14))
    nine = " ".join(f"w{i}" for i in range(9))
    texts = [(1, f"x {item} y"), (2, f"x {nine} y"), (3, "Short,ITEM"), (4, item + " " + item)]
    table = spark.createDataFrame([(1, item), (2, "short item")], "item_id long, text string")
    mine, rows = got(d.find_matches(make_docs(texts), table))
    assert mine == brute(texts, [(1, item), (2, "short item")])
    assert max(m.n_words for r in rows for m in r.matches) == 14


def test_drop_keeps_columns_and_handles_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, "other words"), (3, None)])
    docs = docs.withColumnRenamed("source", "row").withColumnRenamed("lang", "found")
    items = spark.createDataFrame([(1, "A b")], "item_id long, text string")
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert d.drop_contaminated(docs, items.limit(0)).count() == 3
    assert d.drop_contaminated(docs.limit(0), items).count() == 0


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(1)
    for n, kinds, depth in ((0, 1, 5), (1, 1, 5), (300, 2, 40), (300, 1, 400), (500, 400, 9)):
        codes = rng.integers(-3, kinds, n)
        order = d.suffix_array(codes, depth)
        keys = [tuple(codes[i : i + depth]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(n))


def test_query_equals_brute_force(spark, small):
    rows = d.op1(spark, "/root/testdata/sf0.001").collect()
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    want = {w[0]: w for w in brute(docs, items)}
    assert len(rows) == len(docs)
    for r in rows:
        _, n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
        assert r.items_sha256 == d.digest(list(names)) and r.contaminated == (hit > 0)
