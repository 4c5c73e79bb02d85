from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, over two partitions."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]))
            for r in rows
        ]
        return spark.createDataFrame(full, DOCS).repartition(2)

    return make


@pytest.fixture(scope="session")
def small(spark):
    """A table of the smallest test data."""
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
