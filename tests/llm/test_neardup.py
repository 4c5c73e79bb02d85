from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from tidemark.llm import neardup
from tidemark.llm.components import components


def smallest(edges):
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    edges += [("hub", f"s{i}") for i in range(1500)]
    edges += [(f"r{rng.randint(0, 80)}", f"r{rng.randint(0, 80)}") for _ in range(60)]
    edges += [("x", "x")]
    got = components(spark.createDataFrame(edges + [("y", None), edges[0]], "a string, b string"))
    assert {r.node: r.label for r in got.collect()} == smallest(edges)
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute(docs, size=5, least=0.8):
    """Classes by comparing all pairs, with the weights of the operator."""
    docs = [(i, t) for i, t in docs]
    owner, hashes, times = neardup.shingles(pa.array([t for _, t in docs], pa.string()), size)
    table = np.bincount(((hashes >> np.uint64(20)) & np.uint64(neardup.COUNTERS - 1)).astype(int),
                        minlength=neardup.COUNTERS)
    weights = neardup.Weights(table, len(set(owner)))
    w = weights.of(hashes, times)
    sets = [dict(zip(hashes[owner == d], w[owner == d])) for d in range(len(docs))]
    edges, border = [], []
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and sets[a].keys() & sets[b].keys():
                shared = sum(min(v, sets[b][h]) for h, v in sets[a].items() if h in sets[b])
                j = shared / (sum(sets[a].values()) + sum(sets[b].values()) - shared)
                if j >= least:
                    edges.append((a, b))
                    border.append(j)
    label = smallest(edges)
    best = {}
    for d, (i, _) in enumerate(docs):
        best[label.get(d, d)] = min(best.get(label.get(d, d), i), i)
    return {i: best[label.get(d, d)] for d, (i, _) in enumerate(docs)}, edges


def text_of(rng, n=80):
    return [("".join(rng.choice("abcdefghij") for _ in range(5))) for _ in range(n)]


def test_planted_copies(make_docs):
    rng = random.Random(7)
    docs, groups = [], []
    for g in range(12):
        base, ids = text_of(rng, rng.randint(40, 200)), []
        for c in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(c % 3 and max(1, len(words) // 90)):
                words[rng.randrange(len(words))] = "edited"
            ids.append(100 * g + c)
            docs.append((ids[-1], " ".join(words).title() + "." * (c % 2)))
        groups.append(ids)
    docs += [(5000, None), (5001, ""), (5002, "!!!"), (5003, "!!!"), (5004, "two words"),
             (5005, "Two, words"), (5006, "one"), (5007, " ".join(text_of(rng, 30_000)))]
    rows = neardup.classes(make_docs(docs)).collect()
    got = {r.doc_id: r.class_id for r in rows}
    want, _ = brute(docs)
    assert got == want and len(rows) == len(docs)
    assert got[5005] == 5004 and got[5003] == 5003
    kept = {r.doc_id for r in neardup.drop_near_copies(make_docs(docs)).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_repeated_rows_null_ids_and_empty_tables(make_docs):
    rng = random.Random(8)
    text = " ".join(text_of(rng))
    docs = make_docs([(3, text), (3, text), (4, text), (None, text), (None, None), (9, " ".join(text_of(rng)))])
    docs = docs.withColumnRenamed("lang", "version").withColumnRenamed("source", "label")
    rows = [(r.doc_id, r.class_id, r.copies) for r in neardup.classes(docs).collect()]
    assert sorted(rows, key=repr) == sorted(
        [(3, 3, 4), (3, 3, 4), (4, 3, 4), (None, 3, 4), (None, None, 1), (9, 9, 1)], key=repr
    )
    kept = neardup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 9, None, None], key=repr)
    assert neardup.classes(docs.limit(0)).count() == 0
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_without_an_id(make_docs):
    """The text without an id is the head of its buckets, then the other one is; then neither."""
    rng = random.Random(10)
    words = text_of(rng, 200)
    one, other = sorted(
        (" ".join(words), " ".join([*words[:-1], "edited"])), key=lambda t: hashlib.md5(t.encode()).hexdigest()
    )
    for docs in ([(None, one), (1, other)], [(1, one), (None, other)]):
        rows = neardup.classes(make_docs(docs)).collect()
        assert sorted((r.doc_id, r.class_id, r.copies) for r in rows if r.doc_id) == [(1, 1, 1)]
        assert [(r.class_id, r.copies) for r in rows if r.doc_id is None] == [(1, 1)]
    rows = neardup.classes(make_docs([(None, one), (None, other)])).collect()
    assert [(r.doc_id, r.class_id, r.copies) for r in rows] == [(None, None, 1)] * 2


def test_links_past_the_head_are_found(make_docs, monkeypatch):
    """A chain: neighbours are alike, the ends are not, so the head alone links too few."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PAIRS", 3)
    rng = random.Random(9)
    words, docs = text_of(rng, 120), []
    for i in range(14):
        docs.append((i, " ".join(words)))
        words = words[3:] + text_of(rng, 3)
    got = {r.doc_id: r.class_id for r in neardup.classes(make_docs(docs)).collect()}
    assert got == brute(docs)[0] == {i: 0 for i in range(14)}


def test_samples_agree_as_often_as_texts_are_alike():
    rng = random.Random(3)
    base = text_of(rng, 400)
    other = base[:200] + text_of(rng, 200)
    texts = pa.array([" ".join(base), " ".join(other)])
    owner, hashes, times = neardup.shingles(texts, 1)
    weights = neardup.Weights(np.zeros(neardup.COUNTERS), 2)
    hits = []
    for seed in range(30):
        s = neardup.Sampler(weights, seed).sample(owner, hashes, times, 2)
        hits.append((s[0] == s[1]).mean())
    w = weights.of(hashes, times)
    a, b = (dict(zip(hashes[owner == d], w[owner == d])) for d in (0, 1))
    shared = sum(min(v, b[h]) for h, v in a.items() if h in b)
    exact = shared / (sum(a.values()) + sum(b.values()) - shared)
    assert abs(np.mean(hits) - exact) < 0.03


def test_samples_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(4)
    texts = pa.array([" ".join(text_of(rng, n)) for n in (3, 500, 0, 60, 1)])
    owner, hashes, times = neardup.shingles(texts, 5)
    sampler = neardup.Sampler(neardup.Weights(np.zeros(neardup.COUNTERS), 5))
    whole = sampler.sample(owner, hashes, times, 5)
    monkeypatch.setattr(neardup, "CHUNK", 7)
    assert (sampler.sample(owner, hashes, times, 5) == whole).all()


def test_small_table_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    got = {r.doc_id: r.class_id for r in neardup.op7(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs)[0]


def test_a_batch_of_few_words():
    for texts in ([], [None], ["", "!"], ["one"], ["one two", "x"]):
        owner, hashes, times = neardup.shingles(pa.array(texts, pa.string()), 5)
        assert len(owner) == len(hashes) == sum(bool((t or "").strip("!")) for t in texts)
