"""Block search against ranking every document."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as bl
from tidemark.operators import fulltext as ft
from tidemark.operators.ranking import top_k_within

QUERIES = {"one": ["a"], "two": ["a", "b"], "three": ["a", "b", "c"], "rare": ["z"], "none": ["a", "absent"]}


@pytest.fixture(scope="module")
def index(spark):
    """300 documents of very different lengths; ids have gaps and one is negative."""
    rng = random.Random(2)
    rows = []
    for i in range(300):
        n = 200 if i % 40 == 0 else rng.choice([3, 5, 8, 12])
        words = rng.choices("abcdefgh", weights=[9, 5, 2, 1, 1, 1, 1, 1], k=n) + (["z"] if i in (7, 250) else [])
        rows.append((i * 3 - 5, " ".join(words[:2]), " ".join(words[2:])))
    docs = spark.createDataFrame(rows, "posting_id bigint, title string, body string")
    return ft.build_index(docs).cache()


def everything(spark, index, k):
    ranks = ft.text_rank(index, QUERIES)
    best = top_k_within(ranks, "query_id", [F.desc("rank"), F.asc("posting_id")], k, name="place")
    return {(r.query_id, r.place): (r.posting_id, r.rank) for r in best.collect()}


@pytest.mark.parametrize(("k", "block_docs"), [(1, 10), (5, 10), (40, 30), (1000, 10), (3, 10_000)])
def test_equals_ranking_every_document(spark, index, k, block_docs):
    blocks = bl.build_blocks(index, block_docs)
    best, counts = bl.search_topk(blocks, blocks, ft.query_terms(spark, QUERIES), k)
    got = {(r.query_id, r.place): (r.posting_id, r.rank) for r in best.collect()}
    assert got == everything(spark, index, k)
    for r in counts.collect():
        assert r.blocks == r.first + r.second + r.skipped


def test_blocks_are_skipped_and_bounded(spark, index):
    blocks = bl.build_blocks(index, 10)
    _, counts = bl.search_topk(blocks, blocks, ft.query_terms(spark, QUERIES), 2)
    skipped = {r.query_id: r.skipped for r in counts.collect()}
    assert skipped["one"] > 50 and skipped["two"] > 50 and skipped["three"] > 0
    assert blocks.agg(F.max("docs")).first()[0] <= 10


def test_no_document_beats_its_bound(spark, index):
    terms = ft.query_terms(spark, QUERIES)
    bound = {
        (r.query_id, r.block): r.bound
        for r in bl.candidate_blocks(bl.build_blocks(index, 10), terms).collect()
    }
    for r in ft.text_rank(index, QUERIES).collect():
        assert r.rank <= bound[r.query_id, r.posting_id // 10]


def test_stored_blocks_give_the_same_and_prune_folders(spark, index, tmp_path, monkeypatch):
    monkeypatch.setattr(bl, "FOLDER_BLOCKS", 4)
    path = str(tmp_path / "blocks")
    bl.write_blocks(bl.build_blocks(index, 10), path)
    blocks, bounds = bl.read_blocks(spark, path)
    best, _ = bl.search_topk(blocks, bounds, ft.query_terms(spark, QUERIES), 5)
    got = {(r.query_id, r.place): (r.posting_id, r.rank) for r in best.collect()}
    assert got == everything(spark, index, 5)
    plan = best._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "rows" not in bounds.columns


def test_empty_index(spark, index):
    blocks = bl.build_blocks(index.limit(0))
    best, counts = bl.search_topk(blocks, blocks, ft.query_terms(spark, QUERIES), 3)
    assert best.count() == 0 and counts.count() == 0
