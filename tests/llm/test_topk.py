from __future__ import annotations

import numpy as np
import pytest
from tidemark.llm import topk


def brute(rows, queries, k, scale=256):
    def whole(v):
        ok = v is not None and all(x is not None and np.isfinite(x) for x in v)
        return [int(np.floor(float(np.float32(x)) * scale)) for x in v] if ok else None

    have = [(i, whole(v)) for i, v in rows if i is not None]
    have = [x for x in have if x[1] is not None]
    out = []
    for q in queries:
        mine = [v for i, v in have if i == q]
        if not mine:
            continue
        scores = [(-sum(a * b for a, b in zip(min(mine), v)), i) for i, v in have if i != q]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(spark, rows, queries, k=5, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    asked = table.where(table.vec_id.isin(list(queries)))
    found = topk.search(table, asked, k, **options)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("kind", ["plain", "lengths", "copies", "clusters", "huge"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6))
    if kind == "lengths":
        x *= rng.pareto(1.0, size=(150, 1)) + 0.01
    if kind == "copies":
        x[40:120] = x[3]
    if kind == "clusters":
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, 150)] + 0.02 * x
    if kind == "huge":
        x *= 1e6
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    queries = range(0, 150, 10)
    want = brute(rows, queries, 5)
    for options in ({}, {"shard_rows": 20, "block_rows": 4}):
        assert run(spark, rows, queries, **options) == want


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]), (5, []), (6, [0.0, 0.0]), (7, [2.0]), (8, [1.0, 1.0, 5.0]),
        (8, [1.0, 1.0, 5.0]), (None, [1.0, 1.0]), (9, [-1.0, -3.0]), (0, [1.0, 0.0]),
    ]
    queries = [0, 5, 6, 8, 9, 1, 3]
    assert run(spark, rows, queries, k=3) == brute(rows, queries, 3)
    assert run(spark, rows[1:3], [1, 2]) == []
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(table, table).count() == 0


def test_products_are_exact():
    a = np.array([[2**40, 3], [2**62, 1]], np.int64)
    assert topk.products(a, a).tolist() == [[2**63 - 1] * 2, [2**63 - 1] * 2]
    b = np.array([[2**25 + 1, 7]], np.int64)
    assert topk.products(b, b).tolist() == [[(2**25 + 1) ** 2 + 49]]


def test_steep_buckets_are_pruned(monkeypatch):
    """Near copies raise the local cosines, so few products are left."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.floor(256 * np.repeat(base, 100, axis=0) + 3 * rng.normal(size=(6000, 16)))
    counted = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: counted.append(len(a) * len(b)) or real(a, b))
    m = topk.Matrix.__new__(topk.Matrix)
    m.rows, m.ids = x.astype(np.int64), np.arange(6000)
    q = topk.Matrix.__new__(topk.Matrix)
    q.rows, q.ids = m.rows[::100], m.ids[::100]
    best = topk.retrieve(m, q, 5)
    score = real(q.rows, m.rows)
    for i, own in enumerate(q.ids):
        order = sorted((-s, v) for v, s in enumerate(score[i]) if v != own)[:5]
        assert [(-s, v) for v, s in zip(best.vec[best.query == i], best.score[best.query == i])] == [
            (s, v) for s, v in order
        ]
    assert sum(counted) < 0.7 * score.size


def test_query_equals_brute_force(spark, small):
    got = topk.op3(spark, "/root/testdata/sf0.001").collect()
    rows = [(r.vec_id, r.embedding) for r in small("embeddings").collect()]
    ids = [i for i, _ in rows if i % 50 == 0]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, ids, 5)
