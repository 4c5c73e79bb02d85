"""Market statistics, filters and cards over orders, customers, parts and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fields as f
from tidemark.functions import text as t
from tidemark.operators import market
from tidemark.operators.detail import posting_detail
from tidemark.operators.filters import market_filter
from tidemark.operators.fulltext import search_postings
from tidemark.operators.ranking import spread_rows
from tidemark.plans import standin as s


#: Postings, employers, skills and links in SQL, written from their definition.
POSTINGS_SQL = """
  postings AS (
    SELECT o_orderkey AS posting_id, o_custkey AS employer_id,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary,
           CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary_to,
           o_orderpriority AS experience_id, o_orderstatus AS employment_id,
           o_orderstatus = 'O' AS is_remote, o_orderdate AS published_at,
           o_orderpriority || ' ' || o_orderstatus AS title
    FROM orders)
"""
LINKS_SQL = """
  links AS (
    SELECT DISTINCT l_orderkey AS posting_id, lower(p_name) || ' ' || lower(p_brand) AS skill_name
    FROM lineitem JOIN part ON p_partkey = l_partkey),
  skills AS (
    SELECT lower(p_name) || ' ' || lower(p_brand) AS skill_name,
           trim(arg_min('  ' || p_name || '   ' || p_brand || ', ', p_partkey)) AS display_name
    FROM part GROUP BY 1)
"""


def _now() -> Column:
    return F.lit(s.ORDERS_NOW).cast("timestamp_ntz")


def skill_stats(spark: SparkSession, d: str) -> DataFrame:
    return market.skill_stats(s.postings(spark, d), s.links(spark, d), s.skills(spark, d))


_SKILL_STATS_SQL = """
WITH {postings}, {links},
  slice AS (SELECT * FROM postings {where})
SELECT k.skill_name, min(k.display_name) AS display_name, count(*) AS posting_count,
       count(*) / (SELECT count(*) FROM slice)::DOUBLE AS share,
       CAST(trunc(quantile_cont(p.salary, 0.5)) AS BIGINT) AS median_salary
FROM slice p JOIN links l USING (posting_id) JOIN skills k USING (skill_name)
GROUP BY k.skill_name
ORDER BY posting_count DESC, k.skill_name LIMIT 30
"""


def skill_stats_slice(spark: SparkSession, d: str) -> DataFrame:
    """The same for one area and the last 900 days."""
    slice_ = market_filter(
        s.postings_with_area(spark, d), within_days=900, area_id=7, now=_now()
    )
    return market.skill_stats(slice_, s.links(spark, d), s.skills(spark, d))


def market_totals(spark: SparkSession, d: str) -> DataFrame:
    return market.market_totals(s.postings(spark, d))


def by_experience(spark: SparkSession, d: str) -> DataFrame:
    frame = market.by_experience(s.postings(spark, d))
    return frame.select(
        "experience_id",
        f.experience_label(F.col("experience_id")).alias("label"),
        f.experience_rank(F.col("experience_id"), PRIORITIES).alias("level"),
        "n",
    )


#: Order priorities as levels of required experience.
PRIORITIES = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


def experience_labels(spark: SparkSession, d: str) -> DataFrame:
    """Orders per label of their priority: two are named, pending orders have none."""
    names = {"1-URGENT": "at once", "5-LOW": "some day"}
    known = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority"))
    label = f.experience_label(known, names).alias("label")
    return s.table(spark, d, "orders").groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def top_employers(spark: SparkSession, d: str) -> DataFrame:
    return market.top_employers(s.postings(spark, d), s.employers(spark, d))


def salary_by_experience(spark: SparkSession, d: str) -> DataFrame:
    return market.salary_by_experience(s.postings(spark, d))


def weekly_counts_orders(spark: SparkSession, d: str) -> DataFrame:
    return market.weekly_counts(s.postings(spark, d))


def weekly_counts_events(spark: SparkSession, d: str) -> DataFrame:
    return market.weekly_counts(s.table(spark, d, "events"), "ts")


def data_status(spark: SparkSession, d: str) -> DataFrame:
    return market.data_status(
        s.postings(spark, d), s.employers(spark, d), s.skills(spark, d), s.chunks(spark, d)
    )


def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return market.top_groups(s.table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], 20)


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    columns = ["posting_id", "employer_name", "salary_from_base", "experience_name", "is_remote",
               "published_at", "rank"]
    return search_postings(
        s.postings(spark, d),
        s.employers(spark, d),
        salary_min=200_000,
        experience_ids=["1-URGENT", "2-HIGH"],
        remote_only=True,
        within_days=700,
        now=_now(),
        limit=50,
        offset=10,
        columns=columns,
    )


def detail_cards(spark: SparkSession, d: str) -> DataFrame:
    cards = posting_detail(
        s.postings(spark, d), s.employers(spark, d), s.links(spark, d)
    )
    return cards.select(
        "posting_id",
        "salary_from_base",
        "published_at",
        F.col("employer.employer_id").alias("employer_id"),
        F.col("employer.employer_name").alias("employer_name"),
        F.array_join("skills", "|").alias("skills"),
    )


def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """All report frames in one long table of names and values."""
    frames = market.market_report(
        s.postings(spark, d),
        s.employers(spark, d),
        s.skills(spark, d),
        s.links(spark, d),
        s.chunks(spark, d),
    )
    parts = [
        frames["database"].select(
            F.lit("database").alias("frame"),
            F.col("demo").cast("string").alias("name"),
            F.col("postings_total").alias("n"),
        ),
        frames["market"].select(F.lit("market"), F.lit("with_salary"), "with_salary"),
        frames["by_experience"].select(F.lit("by_experience"), "experience_id", "n"),
        frames["top_employers"].select(F.lit("top_employers"), "employer_name", "n"),
        frames["top_skills"].select(F.lit("top_skills"), "skill_name", "posting_count"),
        frames["salary_by_experience"].select(F.lit("salary"), "experience_id", "n"),
        frames["weekly_published"].select(
            F.lit("weekly"), F.date_format("week", "yyyy-MM-dd"), "n"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("- «"), F.col("p_name"), F.lit("   "), F.upper("p_type"), F.lit("++» ,"))
    return s.table(spark, d, "part").select("p_partkey", t.norm_name(raw).alias("name"))


def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names and brands with repeats in other spellings."""
    words = F.split(F.concat_ws(" ", "p_name", F.upper("p_name"), "p_brand", "p_type", "p_name"), " ")
    # a small file of many rows is few tasks; the rules of a name cost more than its row
    return spread_rows(s.table(spark, d, "part"), "p_partkey").select(
        "p_partkey", F.array_join(t.ordered_dedupe(words), "|").alias("names")
    )


def fx_round_even(spark: SparkSession, d: str) -> DataFrame:
    """Line quantities as amounts in several currencies, halves included."""
    codes = {"A": "USD", "N": "kzt", "R": "XYZ"}
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    amount = F.col("l_quantity").cast("int")
    return s.table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        f.to_base_currency(amount, F.element_at(F.create_map(*pairs), F.col("l_returnflag"))).alias("base"),
        f.to_base_currency(amount, F.lit("HLF"), {"HLF": 0.5}).alias("half"),
    )


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "documents").select(
        "doc_id",
        t.snippet(F.col("text"), 120).alias("snippet"),
        t.truncate(F.col("text"), 80).alias("head"),
    )


def flatten_props(spark: SparkSession, d: str) -> DataFrame:
    """The JSON of the events through the loose-value coercions."""
    raw = F.try_parse_json("props")
    return s.table(spark, d, "events").select(
        "event_id",
        f.as_whole(f.at(raw, "$.k")).alias("k"),
        f.as_text(f.at(raw, "$.k")).alias("k_text"),
        f.truthy(f.at(raw, "$.k")).alias("k_true"),
        f.as_flag(f.at(raw, "$.k")).alias("k_flag"),
    )


def _sql(template: str, **more: str) -> str:
    return template.format(postings=POSTINGS_SQL, links=LINKS_SQL, **more)


QUERIES = {
    "skill_stats": (skill_stats, _sql(_SKILL_STATS_SQL, where="")),
    "skill_stats_slice": (
        skill_stats_slice,
        _sql(
            _SKILL_STATS_SQL,
            where="""WHERE published_at >= TIMESTAMP '2001-08-01' - INTERVAL 900 DAY
              AND employer_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)""",
        ),
    ),
    "market_totals": (
        market_totals,
        _sql("""
WITH {postings}
SELECT count(*) AS total, count(salary) AS with_salary,
       CAST(trunc(quantile_cont(salary, 0.25)) AS BIGINT) AS salary_p25,
       CAST(trunc(quantile_cont(salary, 0.5)) AS BIGINT) AS salary_p50,
       CAST(trunc(quantile_cont(salary, 0.75)) AS BIGINT) AS salary_p75,
       count(*) FILTER (WHERE is_remote) / count(*)::DOUBLE AS remote_share
FROM postings"""),
    ),
    "by_experience": (
        by_experience,
        """
SELECT o_orderpriority AS experience_id, o_orderpriority AS label,
       5 - CAST(o_orderpriority[1] AS INTEGER) AS level, count(*) AS n
FROM orders GROUP BY ALL""",
    ),
    "experience_labels": (
        experience_labels,
        """
SELECT coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'at once' WHEN '5-LOW' THEN 'some day' END,
                nullif(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END, ''),
                '%s') AS label, count(*) AS n
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS o_orderpriority,
             o_orderstatus FROM orders)
GROUP BY 1""" % f.EXPERIENCE_UNKNOWN,
    ),
    "top_employers": (
        top_employers,
        """
SELECT c_custkey AS employer_id, c_name AS employer_name, count(*) AS n
FROM orders JOIN customer ON c_custkey = o_custkey
GROUP BY 1, 2 ORDER BY n DESC, employer_id LIMIT 10""",
    ),
    "salary_by_experience": (
        salary_by_experience,
        _sql("""
WITH {postings}
SELECT experience_id, quantile_cont(salary, 0.5) AS median_salary, count(*) AS n
FROM postings WHERE salary IS NOT NULL GROUP BY 1"""),
    ),
    "weekly_counts_orders": (
        weekly_counts_orders,
        """
SELECT CAST(CAST(o_orderdate AS DATE) - (isodow(o_orderdate) - 1)::INTEGER AS TIMESTAMP) AS week,
       count(*) AS n
FROM orders GROUP BY 1""",
    ),
    "weekly_counts_events": (
        weekly_counts_events,
        """
SELECT CAST(CAST(ts AS DATE) - (isodow(ts) - 1)::INTEGER AS TIMESTAMP) AS week, count(*) AS n
FROM events GROUP BY 1""",
    ),
    "data_status": (
        data_status,
        """
SELECT (SELECT count(*) FROM orders) AS postings_total,
       (SELECT count(*) FROM customer) AS employers_total,
       (SELECT count(DISTINCT lower(p_name) || ' ' || lower(p_brand)) FROM part) AS skills_total,
       (SELECT count(*) FROM embeddings) AS chunks_total,
       (SELECT count(embedding) FROM embeddings) AS chunks_embedded,
       'm64' AS model_name,
       (SELECT min(o_orderdate) FROM orders) AS published_from,
       (SELECT max(o_orderdate) FROM orders) AS published_to,
       (SELECT max(o_orderdate) FROM orders) AS last_fetched_at""",
    ),
    "top_groups": (
        top_groups,
        """
SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem
GROUP BY 1, 2 ORDER BY n DESC, l_suppkey, l_returnflag LIMIT 20""",
    ),
    "search_filtered": (
        search_filtered,
        _sql("""
WITH {postings}
SELECT posting_id, c_name AS employer_name, CAST(salary AS INTEGER) AS salary_from_base,
       experience_id AS experience_name, is_remote, published_at, CAST(NULL AS DOUBLE) AS rank
FROM postings LEFT JOIN customer ON c_custkey = employer_id
WHERE salary >= 200000 AND experience_id IN ('1-URGENT', '2-HIGH') AND is_remote
  AND published_at >= TIMESTAMP '2001-08-01' - INTERVAL 700 DAY
ORDER BY published_at DESC NULLS LAST, posting_id LIMIT 50 OFFSET 10"""),
    ),
    "posting_detail": (
        detail_cards,
        _sql("""
WITH {postings}, {links}
SELECT p.posting_id, CAST(p.salary AS INTEGER) AS salary_from_base, p.published_at, c_custkey AS employer_id,
       c_name AS employer_name,
       coalesce((SELECT string_agg(l.skill_name, '|' ORDER BY l.skill_name)
                 FROM links l WHERE l.posting_id = p.posting_id), '') AS skills
FROM postings p LEFT JOIN customer ON c_custkey = p.employer_id"""),
    ),
    "market_report": (
        report_tables,
        _sql("""
WITH {postings}, {links}
SELECT 'database' AS frame, CASE WHEN count(*) < 200 THEN 'true' ELSE 'false' END AS name,
       count(*) AS n FROM postings
UNION ALL SELECT 'market', 'with_salary', count(salary) FROM postings
UNION ALL SELECT 'by_experience', experience_id, count(*) FROM postings GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'top_employers', c_name, count(*) AS n FROM postings
  JOIN customer ON c_custkey = employer_id GROUP BY c_custkey, c_name
  ORDER BY n DESC, c_custkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_skills', skill_name, count(*) AS n
  FROM postings JOIN links USING (posting_id) GROUP BY skill_name
  ORDER BY n DESC, skill_name LIMIT 15)
UNION ALL SELECT 'salary', experience_id, count(salary) FROM postings GROUP BY 2
UNION ALL SELECT 'weekly', strftime(date_trunc('week', published_at), '%Y-%m-%d'), count(*)
  FROM postings GROUP BY 2"""),
    ),
    "normalize_names": (
        normalize_names,
        """
SELECT p_partkey, p_name || ' ' || lower(p_type) || '++' AS name FROM part""",
    ),
    "ordered_dedupe": (
        ordered_dedupe,
        """
WITH w AS (
  SELECT p_partkey, unnest(string_split(concat_ws(' ', p_name, upper(p_name), p_brand, p_type, p_name), ' ')) AS word,
         generate_subscripts(string_split(concat_ws(' ', p_name, upper(p_name), p_brand, p_type, p_name), ' '), 1) AS i
  FROM part),
firsts AS (SELECT p_partkey, arg_min(word, i) AS word, min(i) AS i FROM w GROUP BY p_partkey, lower(word))
SELECT p_partkey, string_agg(word, '|' ORDER BY i) AS names FROM firsts GROUP BY 1""",
    ),
    "fx_round_even": (
        fx_round_even,
        """
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(CASE l_returnflag WHEN 'A' THEN trunc(l_quantity) * 90
            WHEN 'N' THEN round_even(trunc(l_quantity) * 0.19::DOUBLE, 0) END AS INTEGER) AS base,
       CAST(round_even(trunc(l_quantity) * 0.5::DOUBLE, 0) AS INTEGER) AS half
FROM lineitem""",
    ),
    "snippet": (
        snippets,
        """
WITH d AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents)
SELECT doc_id,
       CASE WHEN length(body) <= 120 THEN body
            ELSE regexp_replace(substr(body, 1, 120), '\\s+$', '') || '…' END AS snippet,
       CASE WHEN length(text) <= 80 THEN text
            ELSE regexp_replace(substr(text, 1, 80), '\\s+$', '') || '…' END AS head
FROM d""",
    ),
    "flatten_props": (
        flatten_props,
        """
SELECT event_id, CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) AS k,
       CAST(NULL AS VARCHAR) AS k_text,
       CAST(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT) <> 0 AS k_true,
       CAST(NULL AS BOOLEAN) AS k_flag
FROM events""",
    ),
}
