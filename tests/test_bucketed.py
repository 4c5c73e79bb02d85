"""Tables in key buckets and roll-ups that follow their upserts."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lifecycle as lc
from tidemark.operators import rollup as ru
from tidemark.sources.bucketed import BucketedTable

CARD = "posting_id bigint, title string, salary int, description string"


def cards(spark, rows):
    return spark.createDataFrame(rows, CARD)


def upsert(target, batch):
    changes = lc.latest_changes(batch, "posting_id", "seq", ["title", "salary"], ["description"])
    return lc.merge_changes(target, changes, "posting_id", ["title", "salary"], ["description"])


def batch_of(spark, ids, mark="new"):
    rows = [(i, f"{mark} {i}", None if i % 2 else i, None, 1) for i in ids]
    return spark.createDataFrame(rows, CARD + ", seq int")


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"old {i}", i, f"text {i}") for i in range(400)]
    made = BucketedTable(spark, str(tmp_path / "t"), "posting_id", cards(spark, []).schema, buckets=16)
    made.replace(cards(spark, rows))
    return made


def files_of(table, folder):
    path = os.path.join(table.root, folder)
    return {n: os.stat(os.path.join(path, n)).st_mtime_ns for n in os.listdir(path)}


def test_a_batch_rewrites_only_its_buckets(spark, table):
    before = table.manifest()
    files = {b: files_of(table, f) for b, f in before.items()}
    whole = upsert(table.read(), batch_of(spark, [3, 5, 1000])).collect()
    touched = table.merge(batch_of(spark, [3, 5, 1000]), upsert)
    after = table.manifest()
    assert 1 <= len(touched) <= 3 and len(before) == 16
    for b in before:
        assert (after[b] != before[b]) == (b in touched)
        assert files_of(table, before[b]) == files[b]
    assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(map(tuple, whole), key=repr)


def test_a_merge_reads_only_its_buckets(spark, table):
    read = []

    def watched(target, batch):
        read.extend(target.inputFiles())
        return upsert(target, batch)

    touched = table.merge(batch_of(spark, [3]), watched)
    assert len(touched) == 1 and read and all(f"_bucket={touched[0]}/" in path for path in read)


def test_a_write_cut_off_leaves_the_last_version(spark, table, monkeypatch):
    before = sorted(map(tuple, table.read().collect()))
    version = table.version()

    def lost(self, folders):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(BucketedTable, "_write_manifest", lost)
        with pytest.raises(RuntimeError):
            table.merge(batch_of(spark, range(50)), upsert)
    assert table.version() == version and sorted(map(tuple, table.read().collect())) == before
    # a manifest without its mark does not count either
    os.makedirs(os.path.join(table.root, "manifest", "run=000000000001"))
    assert table.version() == version
    table.merge(batch_of(spark, range(50)), upsert)
    assert table.read().where("title like 'new%'").count() == 50 and table.read().count() == 400


def test_a_reader_keeps_its_version(spark, table):
    reader = table.read()
    table.merge(batch_of(spark, range(400)), upsert)
    assert reader.where("title like 'old%'").count() == 400
    assert table.read().where("title like 'new%'").count() == 400


def test_vacuum_drops_what_no_version_names(spark, table):
    for mark in ("a", "b", "c"):
        table.merge(batch_of(spark, [1, 2, 3], mark), upsert)
    want = sorted(map(tuple, table.read().collect()), key=repr)
    held = set(table.manifest().values())
    assert table.vacuum(keep=1)
    assert sorted(map(tuple, table.read().collect()), key=repr) == want
    assert {f for name in os.listdir(f"{table.root}/data") for f in table._bucket_folders(name).values()} == held


def test_odd_batches(spark, table):
    assert table.merge(batch_of(spark, []), upsert) == []
    gone = spark.createDataFrame([(i,) for i in range(400)], "posting_id bigint")
    table.merge(gone, lambda old, ids: old.join(ids, "posting_id", "left_anti"))
    assert table.manifest() == {} and table.read().count() == 0
    table.merge(batch_of(spark, [7]), upsert)
    assert [r["posting_id"] for r in table.read().collect()] == [7]
    with pytest.raises(ValueError, match="did not read"):
        table.merge(batch_of(spark, [7]), lambda old, new: batch_of(spark, range(100)))


def test_links_are_replaced_by_bucket(spark, tmp_path):
    rows = [(i, name) for i in range(60) for name in ("a", "b")]
    links = spark.createDataFrame(rows, "posting_id bigint, skill_name string")
    table = BucketedTable(spark, str(tmp_path / "links"), "posting_id", links.schema, buckets=8)
    table.replace(links)
    batch = spark.createDataFrame([(1, 1, ["C"]), (2, 1, [])], "posting_id bigint, seq int, skills array<string>")
    table.merge(batch, lc.replace_links)
    found = sorted(map(tuple, table.read().collect()))
    assert found == sorted([r for r in rows if r[0] != 1] + [(1, "c")])


@pytest.mark.parametrize("seed", range(3))
def test_rollups_equal_a_recount(spark, seed):
    """Batches of upserts, one slice holding a third of all rows, nulls in slice and amount."""
    rng = random.Random(seed)

    def row(i):
        return (i, rng.choice(["hot", "hot", "b", None, f"t{i % 7}"]), rng.choice([None, 10, 20, rng.randrange(99)]), "x")

    state = {i: row(i) for i in range(200)}
    counts = ru.rollup(cards(spark, list(state.values())), ["title"], "salary")
    for _ in range(2):
        new = {i: row(i) for i in rng.sample(range(300), 40)}
        before = cards(spark, [state[i] for i in new if i in state])
        changes = ru.signed_changes(before, cards(spark, list(new.values())), ["title"], "salary")
        counts = ru.apply_changes(counts, changes, ["title"], "salary")
        state |= new
    recount = ru.rollup(cards(spark, list(state.values())), ["title"], "salary")
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(map(tuple, recount.collect()), key=repr)
    for keys in (["title"], []):
        mine = ru.slice_statistics(counts, keys, "salary").collect()
        assert sorted(mine, key=repr) == sorted(ru.slice_statistics(recount, keys, "salary").collect(), key=repr)


def test_changes_of_another_rollup_are_refused(spark):
    counts = ru.rollup(cards(spark, [(1, "a", 5, "")]), ["title"], "salary")
    stray = ru.signed_changes(cards(spark, [(2, "b", 5, "")]), cards(spark, []), ["title"], "salary")
    with pytest.raises(Exception, match="do not belong"):
        ru.apply_changes(counts, stray, ["title"], "salary").collect()


def test_empty_rollups(spark):
    counts = ru.rollup(cards(spark, []), ["title"], "salary")
    assert counts.count() == 0 and ru.slice_statistics(counts, ["title"], "salary").count() == 0
    one = cards(spark, [(1, "a", None, "")])
    done = ru.apply_changes(counts, ru.signed_changes(one.limit(0), one, ["title"], "salary"), ["title"], "salary")
    assert [tuple(r) for r in ru.slice_statistics(done, ["title"], "salary").collect()] == [("a", 1, 0, None, None, None)]
    assert done.where(F.col("n") < 1).count() == 0
