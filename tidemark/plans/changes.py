"""Upserts, links, tombstones, cascades and window splitting.

Events act as a change feed of users; order lines as skill mentions of orders.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import fields as f
from tidemark.functions.text import norm_name
from tidemark.operators import lifecycle as lc
from tidemark.operators import rollup as ru
from tidemark.operators.windows import bisect_windows
from tidemark.plans import standin as s
from tidemark.sources.bucketed import BucketedTable
from tidemark.sources.shared import shared_path

#: Events before this moment are already in the target table.
HALF = "2024-01-16 00:00:00"
FEED = ("title", "salary_from")
CARD = """posting_id bigint, title string, salary_from int, description string,
          fetched_at timestamp_ntz, detail_fetched_at timestamp_ntz"""


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as copies of postings: a purchase is a full card with a description.

    The amount is null for every error, which a plain overwrite must carry over.
    """
    k = f.as_whole(f.at(F.try_parse_json("props"), "$.k"), "int")
    full = F.col("event_type") == "purchase"
    return s.table(spark, d, "events").select(
        F.col("user_id").alias("posting_id"),
        F.struct("ts", "event_id").alias("seq"),
        "ts",
        F.col("event_type").alias("title"),
        F.when(F.col("event_type") != "error", F.floor("value").cast("int")).alias("salary_from"),
        F.when(full, F.concat(F.lit("k="), k.cast("string"))).alias("description"),
        full.alias("is_detailed"),
    )


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    feed = _feed(spark, d)
    first = feed.where(F.col("ts") < _at(HALF))
    empty = spark.createDataFrame([], CARD)
    target = lc.upsert_postings(empty, first, FEED, _at("2024-02-01 00:00:00"))
    return target, feed.where(F.col("ts") >= _at(HALF))


def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    target, batch = _halves(spark, d)
    return lc.upsert_postings(target, batch, FEED, _at("2024-02-02 00:00:00"))


def upsert_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """The same through a table in key buckets: only the buckets of the batch are rewritten."""
    target, batch = _halves(spark, d)
    table = BucketedTable(spark, shared_path(spark, "cards"), "posting_id", target.schema, buckets=32)
    table.replace(target)
    moment = _at("2024-02-02 00:00:00")
    table.merge(batch, lambda old, new: lc.upsert_postings(old, new, FEED, moment))
    return table.read()


ROLLUP = ("title",)


def rollup_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Salaries by title after the batch, from the stored roll-up and the touched postings."""
    target, batch = _halves(spark, d)
    after = lc.upsert_postings(target, batch, FEED, _at("2024-02-02 00:00:00"))
    touched = batch.select("posting_id").distinct()
    changes = ru.signed_changes(
        target.join(touched, "posting_id", "left_semi"),
        after.join(touched, "posting_id", "left_semi"),
        ROLLUP,
        "salary_from",
    )
    counts = ru.apply_changes(ru.rollup(target, ROLLUP, "salary_from"), changes, ROLLUP, "salary_from")
    return ru.slice_statistics(counts, ROLLUP, "salary_from")


def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    target, batch = _halves(spark, d)
    return lc.upsert_counts(target, batch)


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Employers from the feed: one per user, named by the newest event type."""
    target = spark.createDataFrame([], schemas.EMPLOYERS.replace("timestamp", "timestamp_ntz"))
    employer = F.struct(
        F.col("user_id").alias("employer_id"),
        F.col("event_type").alias("employer_name"),
        F.col("props").alias("url"),
        (F.col("value") > 10).alias("trusted"),
    )
    batch = s.table(spark, d, "events").select(
        F.struct("ts", "event_id").alias("seq"), "ts", employer.alias("employer")
    )
    seen = lc.upsert_employers(target, batch.where(F.col("ts") < _at(HALF)), _at("2024-02-01 00:00:00"))
    return lc.upsert_employers(seen, batch.where(F.col("ts") >= _at(HALF)), _at("2024-02-02 00:00:00"))


def skill_dimension(spark: SparkSession, d: str) -> DataFrame:
    """Small parts are known skills; all order lines mention theirs in two spellings."""
    part = s.table(spark, d, "part")
    known = (
        part.where(F.col("p_size") <= 10)
        .groupBy(norm_name(F.concat_ws(" ", "p_name", "p_brand")).alias("skill_name"))
        .agg(F.min(F.concat(F.lit("known "), "p_name")).alias("display_name"))
    )
    lines = s.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    label = F.concat(F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lit("."))
    batch = lines.select(
        F.col("l_orderkey").alias("posting_id"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
        F.array(label, F.initcap(label)).alias("skills"),
    )
    return lc.upsert_skills(known, batch)


def link_replace(spark: SparkSession, d: str) -> DataFrame:
    """Links from open lines are the target; closed lines arrive as new copies."""
    lines = s.table(spark, d, "lineitem").join(
        s.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"),
        "l_partkey",
    )
    name = F.concat_ws(" ", "p_name", "p_brand")
    target = (
        lines.where(F.col("l_linestatus") == "O")
        .select(F.col("l_orderkey").alias("posting_id"), norm_name(name).alias("skill_name"))
        .distinct()
    )
    # every copy lists one line's skill, repeated; copies flagged N list none
    listed = F.when(F.col("l_returnflag") != "N", F.array(name, F.upper(name))).otherwise(
        F.array().cast("array<string>")
    )
    batch = lines.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").alias("posting_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
        listed.alias("skills"),
    )
    return lc.replace_links(target, batch)


def _queue(spark: SparkSession, d: str) -> DataFrame:
    detail = F.when(F.col("employment_id") == "F", F.col("published_at"))
    return s.postings(spark, d).withColumn("detail_fetched_at", detail)


def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return lc.pending_details(_queue(spark, d))


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines are gone at the source."""
    lines = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"))
    postings = _queue(spark, d)
    gone = postings.join(lines, "posting_id", "left_anti")
    out = lc.apply_tombstones(postings, gone, _at("2002-01-01 00:00:00"))
    return out.select("posting_id", "archived", "detail_fetched_at")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Employers in debt are deleted with all that hangs on them."""
    employers = s.employers(spark, d)
    chunks = s.table(spark, d, "embeddings").select(F.col("vec_id").alias("posting_id"), "label")
    rest = lc.delete_employers(
        employers.where(~F.col("trusted")), employers, s.postings(spark, d), s.links(spark, d), chunks
    )
    names = ("employers", "postings", "links", "chunks")
    keys = ("employer_id", "posting_id", "posting_id", "posting_id")
    out = None
    for name, key, frame in zip(names, keys, rest):
        part = frame.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(key)).alias("key_sum"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def windows(spark: SparkSession, d: str) -> DataFrame:
    return bisect_windows(
        s.table(spark, d, "events"),
        "ts",
        datetime(2024, 1, 1),
        datetime(2024, 1, 31),
        cap=100,
        min_width=timedelta(hours=6),
    )


_LATEST = """
  feed AS (
    SELECT user_id, ts, event_id, event_type, value,
           CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) END AS amount,
           CASE WHEN event_type = 'purchase'
                THEN 'k=' || regexp_extract(props, '"k":\\s*(\\d+)', 1) END AS description,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age
    FROM events)
"""

UPSERT_SQL = f"""
WITH {_LATEST},
known AS (SELECT user_id, description,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age
  FROM feed WHERE description IS NOT NULL)
SELECT f.user_id AS posting_id, f.event_type AS title, f.amount AS salary_from, k.description,
       CASE WHEN f.ts < '{HALF}' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS fetched_at,
       (SELECT CASE WHEN max(e.ts) < '{HALF}' THEN TIMESTAMP '2024-02-01'
                    WHEN max(e.ts) IS NOT NULL THEN TIMESTAMP '2024-02-02' END
        FROM events e WHERE e.user_id = f.user_id AND e.event_type = 'purchase') AS detail_fetched_at
FROM feed f LEFT JOIN known k ON k.user_id = f.user_id AND k.age = 1
WHERE f.age = 1"""

QUERIES = {
    "upsert_partial": (upsert_partial, UPSERT_SQL),
    "upsert_bucketed": (upsert_bucketed, UPSERT_SQL),
    "rollup_upsert": (
        rollup_upsert,
        f"""
WITH {_LATEST}
SELECT event_type AS title, count(*) AS total, count(amount) AS with_amount,
       CAST(trunc(quantile_cont(amount, 0.25)) AS BIGINT) AS p25,
       CAST(trunc(quantile_cont(amount, 0.5)) AS BIGINT) AS p50,
       CAST(trunc(quantile_cont(amount, 0.75)) AS BIGINT) AS p75
FROM feed WHERE age = 1 GROUP BY event_type""",
    ),
    "upsert_counts": (
        upsert_counts,
        f"""
SELECT count(*) AS seen,
       count(DISTINCT user_id) FILTER (WHERE user_id NOT IN
         (SELECT user_id FROM events WHERE ts < '{HALF}')) AS inserted,
       count(*) - count(DISTINCT user_id) FILTER (WHERE user_id NOT IN
         (SELECT user_id FROM events WHERE ts < '{HALF}')) AS updated
FROM events WHERE ts >= '{HALF}'""",
    ),
    "upsert_latest": (
        upsert_latest,
        f"""
SELECT user_id AS employer_id, event_type AS employer_name, props AS url, value > 10 AS trusted,
       CASE WHEN (SELECT min(ts) FROM events e WHERE e.user_id = x.user_id) < '{HALF}'
            THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS first_seen_at
FROM events x
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "skill_dimension": (
        skill_dimension,
        """
WITH known AS (
  SELECT lower(p_name || ' ' || p_brand) AS skill_name, min('known ' || p_name) AS display_name
  FROM part WHERE p_size <= 10 GROUP BY 1),
mentioned AS (
  SELECT lower(p_name || ' ' || p_brand) AS skill_name,
         upper(p_name) || ' ' || p_brand || '.' AS label, l_orderkey, l_linenumber, l_partkey
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT * FROM known
UNION ALL
SELECT skill_name, label FROM mentioned WHERE skill_name NOT IN (SELECT skill_name FROM known)
QUALIFY row_number() OVER (PARTITION BY skill_name ORDER BY l_orderkey, l_linenumber, l_partkey) = 1""",
    ),
    "link_replace": (
        link_replace,
        """
WITH l AS (
  SELECT l_orderkey AS posting_id, lower(p_name || ' ' || p_brand) AS skill_name, l_linestatus,
         l_returnflag, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON p_partkey = l_partkey),
fresh AS (
  SELECT posting_id, skill_name FROM l WHERE l_linestatus = 'F' AND l_returnflag <> 'N'
  QUALIFY row_number() OVER (PARTITION BY posting_id
    ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT DISTINCT posting_id, skill_name FROM l
WHERE l_linestatus = 'O' AND posting_id NOT IN (SELECT posting_id FROM fresh)
UNION ALL SELECT posting_id, skill_name FROM fresh""",
    ),
    "pending_queue": (
        pending_queue,
        """
SELECT o_orderkey AS posting_id, o_orderdate AS published_at FROM orders
WHERE o_orderstatus <> 'F'""",
    ),
    "tombstones": (
        tombstones,
        """
SELECT o_orderkey AS posting_id,
       o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS archived,
       CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN TIMESTAMP '2002-01-01'
            WHEN o_orderstatus = 'F' THEN o_orderdate END AS detail_fetched_at
FROM orders""",
    ),
    "cascade_delete": (
        cascade_delete,
        """
WITH stay AS (SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey
              WHERE c_acctbal > 0),
lost AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM stay)),
links AS (SELECT DISTINCT l_orderkey AS id, lower(p_name || ' ' || p_brand) AS skill_name
          FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'employers' AS table_name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'postings', count(*), CAST(sum(id) AS BIGINT) FROM stay
UNION ALL SELECT 'links', count(*), CAST(sum(id) AS BIGINT) FROM links
  WHERE id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'chunks', count(*), CAST(sum(vec_id) AS BIGINT) FROM embeddings
  WHERE vec_id NOT IN (SELECT id FROM lost)""",
    ),
    "bisect_windows": (
        windows,
        """
WITH RECURSIVE w(level, a, b, n) AS (
  SELECT 0, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31',
         (SELECT count(*) FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-31')
  UNION ALL
  SELECT level + 1, h.a, h.b,
         (SELECT count(*) FROM events WHERE ts >= h.a AND ts < h.b)
  FROM w, LATERAL (
    SELECT w.a AS a, w.a + to_microseconds(date_diff('microsecond', w.a, w.b) // 2) AS b
    UNION ALL
    SELECT w.a + to_microseconds(date_diff('microsecond', w.a, w.b) // 2), w.b) h
  WHERE w.n > 100 AND date_diff('microsecond', w.a, w.b) > 21600000000)
SELECT level, a AS window_start, b AS window_end, n, n > 100 AS over_full
FROM w
WHERE n > 0 AND (n <= 100 OR date_diff('microsecond', a, b) <= 21600000000)""",
    ),
}
