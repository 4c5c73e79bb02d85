from __future__ import annotations

import hashlib

import corpus_pipeline as cp
import duckdb
import pytest
from tidemark.llm import linededup, quality

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_neardup import brute as classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's output over the smallest documents, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "text").collect()))


def test_names_and_columns(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "benchmark", "tokens"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == columns for df in stages[:-1])


def test_each_stage_equals_brute_force_on_its_own_input(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = quality.score(docs, quality.train(docs, labels)).collect()
    assert rows(stages[0]) == sorted((r.row.doc_id, r.row.text) for r in scores if r.out >= 0.3)
    con = duckdb.connect()
    con.register("documents", stages[0].toArrow())
    lines = con.execute(linededup.OP5_SQL).fetchall()
    assert rows(stages[1]) == sorted((r[0], r[3]) for r in lines)
    kept, _ = classes(rows(stages[1]))
    assert rows(stages[2]) == [(i, t) for i, t in rows(stages[1]) if kept[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in leaks(rows(stages[2]), items) if not hit}
    assert rows(stages[3]) == [(i, t) for i, t in rows(stages[2]) if i in clean]
    text = dict(rows(stages[3]))
    for r in stages[4].collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert stages[4].count() == len(text)


def test_odd_rows_go_through(spark, make_docs):
    odd = make_docs([(1, None), (2, ""), (3, "a plain text"), (None, "x"), (3, "a plain text")])
    for docs in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.count() >= 0
