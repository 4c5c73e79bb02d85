"""The test tables in the roles of the domain tables.

Orders act as postings, customers as employers, parts as skills, order lines as the
links, pages and documents as texts, embedding rows as chunks.  Whole tables throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import norm_name

#: Fixed "now" of the order data.
ORDERS_NOW = "2001-08-01 00:00:00"
FIRST_SEEN = "2000-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders; the amount of a pending order counts as an undisclosed salary."""
    amount = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("posting_id"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
        F.col("o_custkey").alias("employer_id"),
        amount.alias("salary_from_base"),
        F.when(F.col("o_orderstatus") == "P", F.floor("o_totalprice").cast("int")).alias(
            "salary_to_base"
        ),
        F.lit("RUR").alias("salary_currency"),
        F.col("o_orderpriority").alias("experience_id"),
        F.col("o_orderpriority").alias("experience_name"),
        F.col("o_orderstatus").alias("employment_id"),
        (F.col("o_orderstatus") == "O").alias("is_remote"),
        F.lit(None).cast("string").alias("description"),
        F.col("o_orderdate").alias("published_at"),
        F.col("o_orderdate").alias("fetched_at"),
        F.lit(False).alias("archived"),
    )


def employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("employer_id"),
        F.col("c_name").alias("employer_name"),
        F.col("c_nationkey").alias("area_id"),
        F.col("c_mktsegment").alias("url"),
        (F.col("c_acctbal") > 0).alias("trusted"),
    )


def postings_with_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the area of their employer, as a collected posting carries it."""
    areas = employers(spark, sf_dir).select("employer_id", "area_id").join(
        table(spark, sf_dir, "nation").select(
            F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area_name")
        ),
        "area_id",
    )
    return postings(spark, sf_dir).join(areas, "employer_id", "left")


def _skill_label() -> Column:
    return F.concat(F.lit("  "), F.col("p_name"), F.lit("   "), F.col("p_brand"), F.lit(", "))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per normalised part label; the label of the lowest part key is displayed."""
    named = table(spark, sf_dir, "part").select(
        norm_name(_skill_label()).alias("skill_name"), _skill_label().alias("label"), "p_partkey"
    )
    return named.groupBy("skill_name").agg(
        F.trim(F.min_by("label", "p_partkey")).alias("display_name")
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (posting, skill) pairs of the order lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    named = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), norm_name(_skill_label()).alias("skill_name")
    )
    return (
        lines.join(named, "l_partkey")
        .select(F.col("l_orderkey").alias("posting_id"), "skill_name")
        .distinct()
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows: the label is the parent, the vector id the chunk index."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("posting_id"),
        F.col("vec_id").cast("long").alias("chunk_index"),
        F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
        F.lit("m64").alias("model_name"),
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings with text: the first line is the title, the rest the body."""
    text = F.col("text")
    title = F.substring_index(text, "\n", 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("posting_id"),
        title.alias("title"),
        F.substr(text, F.length(title) + 2).alias("body"),
        "lang",
        "source",
        "n_chars",
    )
