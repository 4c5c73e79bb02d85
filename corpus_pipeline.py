"""A training-data pipeline: five operators of tidemark.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs.  All but the last return the columns of docs.

* quality: documents that the factorisation machine scores under 0.3 go.
* lines: lines of recurring templates go out of the texts.
* near_copies: of each class of near copies the document with the smallest id stays.
* benchmark: documents with words of a benchmark item's run go.
* tokens: each document's byte-level BPE ids and decoded bytes, as digests.

A null or empty text is scored as an empty one, has no lines, near copies, or benchmark words, and
has no tokens.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, common, decontaminate, linededup, neardup
from tidemark.llm import quality as fm


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: The classifier, the samples and the tokens cannot be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
