"""JSON ingest over the orders: nested records are built as text, read, flattened and counted.

An order becomes a raw posting with its customer as the employer.  Its number decides which of
the odd shapes it takes: a page of items, a list, an older salary form, text for numbers, a
missing id, or an amount that no column holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifecycle import batch_report
from tidemark.operators.ranking import spread_rows
from tidemark.plans import standin as s
from tidemark.sources.postings import expand_records, flatten_postings, split_rejects


def raw_records(spark: SparkSession, d: str) -> DataFrame:
    """Loose values with a source position, as `read_records` reads them from files."""
    # a file of few row groups is few tasks; reading a record costs far more than its row
    orders = spread_rows(s.table(spark, d, "orders"), "o_orderkey")
    customers = s.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("o_orderkey")
    amount = F.floor("o_totalprice") * F.when(key % 50 == 7, 1_000_000_000).otherwise(1)
    salary = F.struct(
        amount.alias("from"),
        F.when(key % 3 == 0, (amount + 5).cast("string")).alias("to"),
        F.when(key % 4 == 0, F.lit("usd")).otherwise(F.lit("RUR")).alias("currency"),
        (key % 2 == 0).alias("gross"),
    )
    record = F.struct(
        F.when(key % 40 == 3, F.lit("none")).otherwise(key.cast("string")).alias("id"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("name"),
        F.when(key % 5 != 0, salary).alias("salary_range"),
        F.when(key % 5 == 0, salary).alias("salary"),
        F.when(
            key % 6 != 1,
            F.struct(
                F.col("o_custkey").cast("string").alias("id"),
                F.col("c_name").alias("name"),
                (F.col("c_acctbal") > 0).alias("trusted"),
            ),
        ).alias("employer"),
        F.struct(F.when(key % 7 == 2, F.lit("remote")).otherwise(F.lit("fullDay")).alias("id")).alias("schedule"),
        F.struct(F.col("o_orderstatus").alias("id")).alias("employment"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+0300'").alias("published_at"),
        F.array(
            F.struct(F.col("o_orderstatus").alias("name")),
            F.struct(F.concat(F.lit("- "), F.col("o_orderpriority"), F.lit(",")).alias("name")),
            F.struct(F.lower("o_orderstatus").alias("name")),
        ).alias("key_skills"),
        (F.col("o_orderstatus") == "F").alias("archived"),
    )
    alone = F.to_json(record)
    text = (
        F.when(key % 9 == 0, F.concat(F.lit('{"items": ['), alone, F.lit("]}")))
        .when(key % 9 == 1, F.concat(F.lit('[7, '), alone, F.lit(', "junk"]')))
        .when(key % 90 == 5, F.lit('{"id": '))
        .otherwise(alone)
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.try_parse_json(text).alias("payload"), F.lit("orders").alias("file"), key.alias("block")
    )


def flattened(spark: SparkSession, d: str) -> DataFrame:
    return flatten_postings(expand_records(raw_records(spark, d)))


def ingest(spark: SparkSession, d: str) -> DataFrame:
    """Typed postings that can be loaded."""
    good, _ = split_rejects(flattened(spark, d))
    return good.select(
        "posting_id", "title", "employer_id", F.col("employer.employer_name").alias("employer_name"),
        F.col("employer.trusted").alias("trusted"), "salary_from", "salary_to", "salary_currency",
        "salary_gross", "salary_from_base", "salary_to_base", "employment_id", "is_remote",
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "archived",
        F.array_join("skills", "|").alias("skills"),
    )


def rejects(spark: SparkSession, d: str) -> DataFrame:
    """Records that cannot be loaded: their place and the reason."""
    _, bad = split_rejects(flattened(spark, d))
    return bad.select(F.col("seq.block").alias("block"), "problem")


def counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the batch against a table that holds every third order."""
    good, _ = split_rejects(flattened(spark, d))
    known = s.postings(spark, d).where(F.col("posting_id") % 3 == 0)
    return batch_report(known, good)


_RAW = """
raw AS (
  SELECT o_orderkey AS k, o.*, c.*,
         CAST(floor(o_totalprice) AS HUGEINT) * CASE WHEN o_orderkey % 50 = 7 THEN 1000000000 ELSE 1 END AS amount,
         CASE WHEN o_orderkey % 9 NOT IN (0, 1) AND o_orderkey % 90 = 5 THEN 'not JSON'
              WHEN o_orderkey % 40 = 3 THEN 'no usable id'
              WHEN o_orderkey % 50 = 7 AND floor(o_totalprice) >= 3 THEN 'salary out of range' END AS problem
  FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey),
good AS (SELECT *, k % 6 <> 1 AS named, CASE WHEN k % 4 = 0 THEN 90 ELSE 1 END AS rate FROM raw WHERE problem IS NULL)
"""

QUERIES = {
    "ingest_json": (
        ingest,
        f"""
WITH {_RAW}
SELECT k AS posting_id, o_orderpriority AS title, CASE WHEN named THEN o_custkey END AS employer_id,
       CASE WHEN named THEN c_name END AS employer_name, CASE WHEN named THEN c_acctbal > 0 END AS trusted,
       CAST(amount AS INTEGER) AS salary_from,
       CASE WHEN k % 3 = 0 THEN CAST(amount + 5 AS INTEGER) END AS salary_to,
       CASE WHEN k % 4 = 0 THEN 'usd' ELSE 'RUR' END AS salary_currency, k % 2 = 0 AS salary_gross,
       CAST(amount * rate AS INTEGER) AS salary_from_base,
       CASE WHEN k % 3 = 0 THEN CAST((amount + 5) * rate AS INTEGER) END AS salary_to_base,
       o_orderstatus AS employment_id, k % 7 = 2 AS is_remote,
       strftime(o_orderdate - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS published_at,
       o_orderstatus = 'F' AS archived, o_orderstatus || '|- ' || o_orderpriority || ',' AS skills
FROM good""",
    ),
    "ingest_rejects": (
        rejects,
        f"WITH {_RAW} SELECT k AS block, problem FROM raw WHERE problem IS NOT NULL",
    ),
    "ingest_counters": (
        counters,
        f"""
WITH {_RAW}
SELECT count(*) AS seen, count(*) FILTER (WHERE k % 3 <> 0) AS inserted, count(*) FILTER (WHERE k % 3 = 0) AS updated,
       count(*) FILTER (WHERE named AND c_name IS NOT NULL) AS employers_touched, 2 * count(*) AS skills_linked
FROM good""",
    ),
}
