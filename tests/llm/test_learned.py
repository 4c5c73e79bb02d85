from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tidemark.llm import common, langid, quality


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_on_held_out_rows(spark, small):
    rows = langid.op10(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in small("documents").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)


def test_language_ignores_other_columns(spark, make_docs):
    rows = [(i, "the and of that with this", "en") for i in range(1, 20)]
    rows += [(i, "der die das und nicht für", "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 34 !!", "en"), (53, "und nicht", None)]
    rows += [(54, "the that", "de"), (1, "the and of that with this", "en"), (None, "und das", "x")]
    docs = make_docs(rows)
    model = langid.train(docs)
    got = [(r.row.doc_id, r.out.lang, r.out.score) for r in langid.identify(docs, model, reject=False).collect()]
    by = {i: lang for i, lang, _ in got}
    assert by[50] == by[51] == by[52] == "und" and by[53] == "de" and by[2] == "en" and by[30] == "de"
    assert len(got) == len(rows) and "x" not in by.values()
    assert all(s == 0 for i, lang, s in got if lang == "und")
    strange = make_docs([(1, "qqq xxx zzz jjj www"), (2, "the and of that with this")])
    far = {r.row.doc_id: r.out for r in langid.identify(strange, model).collect()}
    assert far[1].lang == "und" and far[1].rejected and far[2].lang == "en"
    none = langid.train(docs.limit(0))
    assert {r.out.lang for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_trigrams_stay_inside_texts():
    alone = langid.ngram_counts(pa.array(["abc", "", "de", None, "Abcd"]))
    assert alone.sum(axis=1).tolist() == [1, 0, 0, 0, 2]
    assert (alone[4] >= alone[0]).all()


def test_quality_on_held_out_rows(spark, small):
    d = "/root/testdata/sf0.01"
    rows = quality.op2(spark, d).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    good = sum(r.predicted == marks[r.doc_id] for r in held)
    assert good >= 0.95 * len(held)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_quality_rows_and_columns(spark, make_docs):
    good = "a plain line of quiet words about rivers"
    rows = [(i, f"{good} {i}") for i in range(1, 40)] + [(i, "BUY!! BUY!! NOW!! " * 9) for i in range(40, 60)]
    rows += [(60, None), (61, ""), (62, "x" * 300_000), (41, "BUY!! BUY!! NOW!! " * 9), (None, good)]
    docs = make_docs(rows)
    labels = spark.createDataFrame(
        [(i, int(i < 40), 0) for i in range(1, 60)] + [(5, None, 0), (None, 1, 0), (7, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.train(docs, labels)
    scored = {r.row.doc_id: r.out for r in quality.score(docs, model).collect()}
    assert scored[3] > 0.5 > scored[45] and 0 <= scored[60] == scored[60] and scored[60] <= 1
    kept = quality.drop_poor(docs.withColumnRenamed("lang", "row").withColumnRenamed("source", "out"), labels)
    assert kept.columns == ["doc_id", "text", "row", "out", "n_chars"]
    ids = {r.doc_id for r in kept.collect()}
    assert 3 in ids and 45 not in ids
    # neither ids nor language nor source are inputs
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    again = {r.row.doc_id: r.out for r in quality.score(other, model).collect()}
    assert again == scored
    assert quality.score(docs.drop("n_chars"), model).count() == len(rows)
    blank = quality.train(docs, labels.limit(0), epochs=1)
    assert {r.out for r in quality.score(docs, blank).collect()} != set()
    assert quality.score(docs.limit(0), model).count() == 0


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine()
    m.factor = rng.normal(size=m.factor.shape).astype(np.float32) * 0.3
    m.weight = rng.normal(size=m.weight.shape).astype(np.float32)
    bounds, index, value = quality.features(pa.array(["one two two three", "", None, "É 4"]))
    for t, got in enumerate(m.score(bounds, index, value)):
        i, v = index[bounds[t] : bounds[t + 1]], value[bounds[t] : bounds[t + 1]].astype(float)
        z = m.bias + (m.weight[i] * v).sum()
        for a in range(len(i)):
            for b in range(a):
                z += float(m.factor[i[a]] @ m.factor[i[b]]) * v[a] * v[b]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


def test_words_of_tables():
    texts = ["Ab c-d", "", None, "É9 x", "\x00a b"]
    w = common.words_of(pa.array(texts))
    names = [v.decode("utf-8", "replace") for v in w.vocabulary.to_pylist()]
    read = lambda w, names: [[names[c] for c in w.codes[a:b]] for a, b in zip(w.bounds, w.bounds[1:])]
    assert read(w, names) == [["ab", "c", "d"], [], [], ["É9", "x"], ["a", "b"]]
    w = common.words_of(pa.array(texts), common.SPACED)
    assert [len(x) for x in read(w, list(range(99)))] == [2, 0, 0, 2, 2]
    assert common.words_of(pa.array([], pa.string())).codes.size == 0
    sizes = [len(s) for s in common.slices(pa.array(["aa"] * 5 + ["b" * 50, "c"]), 6)]
    assert sum(sizes) == 7 and max(sizes) <= 3
