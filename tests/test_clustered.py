"""Lookups in tables stored by key ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fulltext as ft
from tidemark.sources.clustered import write_clustered


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(5000).select(
        (F.col("id") * 3).alias("posting_id"),
        F.concat(F.lit("title "), F.col("id")).alias("title"),
        F.repeat(F.lit("wide "), 50).alias("description"),
        F.timestamp_seconds(F.col("id")).alias("published_at"),
    )


@pytest.fixture(scope="module")
def store(spark, table, tmp_path_factory):
    return write_clustered(table, str(tmp_path_factory.mktemp("store") / "t"), "posting_id", files=20)


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "posting_id bigint")


def test_ranges_cover_the_table_without_overlap(store, table):
    ranges = sorted((r.low, r.high, r.n) for r in store.ranges().collect())
    assert len(ranges) >= 15 and sum(n for *_, n in ranges) == table.count()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_a_lookup_opens_only_the_files_of_its_keys(spark, store):
    asked = keys(spark, [0, 3, 14_997, 7, None, 3, 99_999])
    found = store.lookup(asked, ["title"])
    assert sorted(map(tuple, found.collect())) == [(0, "title 0"), (3, "title 1"), (14_997, "title 4999")]
    opened = {f.rsplit("/", 1)[-1] for f in found.inputFiles() if "/rows/" in f}
    every = {r.file.rsplit("/", 1)[-1] for r in store.ranges().collect()}
    assert len(opened) <= 3 < len(every) and opened < every
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "description" not in plan


def test_long_and_empty_key_lists_give_the_same_rows(spark, store):
    asked = keys(spark, range(0, 300))
    by_files = sorted(map(tuple, store.lookup(asked, ["title"]).collect()))
    by_join = sorted(map(tuple, store.lookup(asked, ["title"], most_keys=10).collect()))
    assert by_files == by_join and len(by_files) == 100
    assert store.lookup(keys(spark, [])).count() == store.lookup(keys(spark, [1, -5])).count() == 0


def test_search_reads_wide_columns_from_the_store(spark, table, store):
    narrow = table.select("posting_id", "published_at")
    columns = ["posting_id", "title", "description", "rank"]
    index = ft.build_index(table.withColumn("body", F.lit("")))
    for text in ("title 77", None):
        plain = ft.search_postings(table, None, index, text, limit=3, columns=columns).collect()
        found = ft.search_postings(narrow, None, index, text, limit=3, columns=columns, store=store)
        assert found.collect() == plain and len(plain) in (1, 3)
        assert len([f for f in found.inputFiles() if "/rows/" in f]) <= 3
