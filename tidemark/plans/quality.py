"""Profile matching and retrieval evaluation.

Benchmark texts act as labelled queries: the documents that contain one are relevant to
it.  Two rankings are judged by the longest and the shortest word of the query, and the text,
semantic and hybrid searches by its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import words
from tidemark.operators import evaluation as ev
from tidemark.operators import fulltext as ft
from tidemark.operators.letters import LETTERS, letter_counts
from tidemark.operators.matching import match_profile, match_profiles, with_skills
from tidemark.operators.ranking import spread_rows, top_k_within
from tidemark.operators.setjoin import good_matches
from tidemark.plans import standin as s
from tidemark.plans.market import LINKS_SQL, POSTINGS_SQL, PRIORITIES
from tidemark.plans.text import HITS_SQL
from tidemark.sources.parameters import Profile

METHODS = ("longest", "shortest")
KS = (1, 5, 10)


def profile() -> Profile:
    brands = range(1, 26)
    skills = {f"red widget brand#{i}": "strong" for i in brands}
    skills |= {f"blue bolt brand#{i}": "working" for i in brands}
    skills |= {f"small ring brand#{i}": "basic" for i in brands}
    skills |= {f"green nut brand#{i}": "unheard" for i in brands}
    return Profile(
        title="test candidate",
        skills=skills,
        missing=tuple(f"hot gear brand#{i}" for i in brands),
        salary_min_base=150_000,
        remote_only=False,
        employment=("O", "P"),
        max_experience="2-HIGH",
        red_flags=(" urgent P ", "low o"),
        green_flags=("MEDIUM",),
    )


def match_orders(spark: SparkSession, d: str) -> DataFrame:
    postings = with_skills(s.postings(spark, d), s.links(spark, d))
    matched = match_profile(postings, profile(), PRIORITIES)

    def codes(name: str):
        parts = F.transform(name, lambda f: F.concat_ws("=", f["code"], f["value"]))
        return F.array_join(parts, "|").alias(name)

    return matched.select(
        "posting_id",
        "verdict",
        F.round("score", 6).alias("score"),
        F.array_join("matched_skills", "|").alias("matched_skills"),
        F.size("missing_skills").cast("long").alias("n_missing"),
        codes("blockers"),
        codes("notes"),
    )


def nation_profiles(spark: SparkSession, d: str) -> list[Profile]:
    """A profile per nation: its key picks skills, salary and place."""
    rows = s.table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    return [
        Profile(
            title=name,
            skills={f"red widget brand#{key + 1}": "strong", f"blue bolt brand#{key + 1}": "basic"},
            salary_min_base=10_000 * key,
            remote_only=key % 2 == 0,
            max_experience="2-HIGH",
        )
        for key, name in rows
    ]


def match_many(spark: SparkSession, d: str) -> DataFrame:
    """Orders that suit each nation's profile, all profiles in one pass."""
    postings = with_skills(s.postings(spark, d), s.links(spark, d))
    found = match_profiles(postings, nation_profiles(spark, d), PRIORITIES, ("good",))
    return found.select(
        "profile", "posting_id", F.round("score", 6).alias("score"),
        F.array_join("matched_skills", "|").alias("matched_skills"),
    )


def customer_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile per customer: nation and key pick its skills, the balance its salary."""
    key = F.col("c_custkey")
    none = F.array().cast("array<string>")

    def skill(name: str, number):
        return F.concat(F.lit(f"{name} brand#"), number.cast("string"))

    return s.table(spark, d, "customer").select(
        F.col("c_name").alias("title"),
        F.create_map(
            skill("red widget", F.col("c_nationkey") + 1), F.lit("strong"),
            skill("blue bolt", key % 25 + 1), F.lit("basic"),
            skill("hot gear", key % 5 + 1), F.lit("working"),
        ).alias("skills"),
        none.alias("missing"),
        (F.greatest(F.floor("c_acctbal"), F.lit(0)) * 20).cast("int").alias("salary_min_base"),
        (key % 2 == 0).alias("remote_only"),
        none.alias("employment"),
        F.lit("2-HIGH").alias("max_experience"),
        none.alias("red_flags"),
        none.alias("green_flags"),
    )


def match_set_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders that suit each customer's profile; the profiles stay a table."""
    shown = {"score": F.round("score", 6), "matched_skills": F.array_join("matched_skills", "|")}
    found = good_matches(
        s.postings(spark, d), s.links(spark, d), customer_profiles(spark, d), PRIORITIES, shown=shown
    )
    return found.select("profile", "posting_id", "score", "matched_skills")


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries: the escaped text is the pattern."""
    escaped = F.regexp_replace("text", r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return s.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.col("text").alias("query"),
        F.lit("copy").alias("intent"),
        F.array().cast("array<bigint>").alias("relevant_ids"),
        F.array(escaped).alias("patterns"),
    )


def _whole_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = s.table(spark, d, "documents").select(
        F.col("doc_id").alias("posting_id"), F.col("text").alias("title")
    )
    return docs


def truth(spark: SparkSession, d: str) -> DataFrame:
    return ev.ground_truth(benchmark_queries(spark, d), _whole_texts(spark, d))


def rankings(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents per benchmark text and method."""
    word = s.table(spark, d, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.explode(F.array_distinct(words(F.col("text")))).alias("term"),
    )
    chosen = word.groupBy("query_id").agg(
        F.max_by("term", F.struct(F.length("term"), "term")).alias(METHODS[0]),
        F.min_by("term", F.struct(F.length("term"), "term")).alias(METHODS[1]),
    )
    chosen = chosen.unpivot("query_id", list(METHODS), "method", "term")
    # queries share words: each distinct word is ranked once, cut to the top, then handed out
    terms = chosen.select("term").distinct().select(
        F.col("term").alias("query_id"), "term", F.lit(0).alias("ordinal"), F.lit(1).alias("n_terms")
    )
    ranked = ft.rank_terms(ft.build_index(s.document_texts(spark, d)), terms)
    top = top_k_within(
        ranked.withColumnRenamed("rank", "score"), "query_id", [F.desc("score"), F.asc("posting_id")], max(KS)
    )
    return chosen.join(top.withColumnRenamed("query_id", "term"), "term").select(
        "method", "query_id", "posting_id", "rank"
    )


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = ev.evaluate_rankings(
        rankings(spark, d), truth(spark, d), benchmark_queries(spark, d), METHODS, KS
    )
    return found.withColumn("value", F.round("value", 6))


def retrieval_failures(spark: SparkSession, d: str) -> DataFrame:
    found = ev.retrieval_failures(
        rankings(spark, d),
        truth(spark, d),
        s.document_texts(spark, d),
        benchmark_queries(spark, d),
        METHODS,
        KS,
    )
    return _failure_rows(found)


def _failure_rows(found: DataFrame) -> DataFrame:
    shown = F.transform(
        "returned", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["posting_id"].cast("string"))
    )
    return found.select(
        "method",
        "query_id",
        "expected",
        F.coalesce(F.array_join(shown, "|"), F.lit("")).alias("returned"),
    )


def labelled_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts, every fourth labelled by an id instead of a pattern."""
    by_id = F.col("query_id").cast("bigint") % 4 == 0
    own = F.array(F.col("query_id").cast("bigint"))
    return benchmark_queries(spark, d).withColumn(
        "relevant_ids", F.when(by_id, own).otherwise(F.col("relevant_ids"))
    )


def search_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Ten best documents per whole benchmark text and search; lines are the chunks."""
    queries = labelled_queries(spark, d)
    lines = s.table(spark, d, "documents").select(
        F.col("doc_id").alias("posting_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "line")
    )
    chunks = lines.select("posting_id", "chunk_index", letter_counts(F.col("line")).alias("embedding"))
    vectors = queries.select("query_id", letter_counts(F.col("query")).alias("embedding"))
    index = ft.build_index(s.document_texts(spark, d), in_batches=True)
    return ev.method_rankings(index, chunks, queries, vectors, max(KS), 0.4)


def search_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries = labelled_queries(spark, d)
    found = ev.evaluate_rankings(
        search_rankings(spark, d), ev.ground_truth(queries, _whole_texts(spark, d)), queries, ev.SEARCHES, KS
    )
    return found.withColumn("value", F.round("value", 6))


def search_failures(spark: SparkSession, d: str) -> DataFrame:
    queries = labelled_queries(spark, d)
    truth_ = ev.ground_truth(queries, _whole_texts(spark, d))
    found = ev.retrieval_failures(
        search_rankings(spark, d), truth_, s.document_texts(spark, d), queries, ev.SEARCHES, KS
    )
    return _failure_rows(found)


RANKINGS_SQL = f"""
  {HITS_SQL},
  bw AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term
         FROM benchmark),
  chosen AS (SELECT item_id, 'longest' AS method, term FROM bw
             QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(term) DESC, term DESC) = 1
             UNION ALL SELECT item_id, 'shortest', term FROM bw
             QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(term), term) = 1),
  rankings AS (
    SELECT method, CAST(item_id AS VARCHAR) AS query_id, posting_id,
           row_number() OVER (PARTITION BY method, item_id ORDER BY round(sum(w), 9) DESC, posting_id) AS rank
    FROM chosen JOIN hits USING (term) GROUP BY method, item_id, posting_id QUALIFY rank <= 10),
  truth AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, doc_id AS posting_id
            FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  expected AS (SELECT query_id, count(*) AS expected FROM truth GROUP BY 1),
  methods AS (SELECT unnest(['longest', 'shortest']) AS method),
  judged AS (SELECT m.method, e.query_id, e.expected, r.rank, r.posting_id
             FROM methods m CROSS JOIN expected e
             LEFT JOIN (SELECT r.* FROM rankings r JOIN truth USING (query_id, posting_id)) r
               ON r.method = m.method AND r.query_id = e.query_id)
"""


def _metric_sql(rankings_sql: str) -> str:
    parts = []
    for k in KS:
        inner = f"""SELECT method, query_id, expected, count(*) FILTER (WHERE rank <= {k}) AS h
                    FROM judged GROUP BY ALL"""
        parts.append(f"SELECT method, 'recall' AS metric, {k} AS k, avg(h / expected::DOUBLE) AS value FROM ({inner}) GROUP BY 1")
        parts.append(f"SELECT method, 'precision', {k}, avg(h / {k}::DOUBLE) FROM ({inner}) GROUP BY 1")
    parts.append("""SELECT method, 'mrr', NULL, avg(coalesce(1.0::DOUBLE / first, 0))
        FROM (SELECT method, query_id, min(rank) AS first FROM judged GROUP BY ALL) GROUP BY 1""")
    parts.append("SELECT method, 'evaluated', NULL, count(DISTINCT query_id) FROM judged GROUP BY 1")
    parts.append("""SELECT method, 'skipped', NULL,
        (SELECT count(*) FROM benchmark) - count(DISTINCT query_id) FROM judged GROUP BY 1""")
    body = " UNION ALL ".join(parts)
    return f"WITH {rankings_sql} SELECT method, metric, k, round(value, 6) AS value FROM ({body})"


def _failure_sql(rankings_sql: str) -> str:
    return f"""
WITH {rankings_sql}
SELECT j.method, j.query_id, any_value(j.expected) AS expected,
       coalesce((SELECT string_agg(r.rank || ':' || r.posting_id, '|' ORDER BY r.rank) FROM rankings r
                 WHERE r.method = j.method AND r.query_id = j.query_id AND r.rank <= 5), '') AS returned
FROM judged j GROUP BY j.method, j.query_id
HAVING count(*) FILTER (WHERE j.rank <= 5) = 0"""


def _letters_sql(text: str) -> str:
    counts = ", ".join(
        f"(length({text}) - length(regexp_replace({text}, '[{x}{x.upper()}]', '', 'g')))::DOUBLE" for x in LETTERS
    )
    return f"[{counts}]"


SEARCHES_SQL = f"""
  {HITS_SQL},
  qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term
         FROM benchmark),
  sizes AS (SELECT item_id, count(*) AS n FROM qt GROUP BY 1),
  full_match AS (SELECT item_id, posting_id, n
                 FROM qt JOIN (SELECT DISTINCT term, posting_id FROM hits) USING (term) JOIN sizes USING (item_id)
                 GROUP BY ALL HAVING count(*) = n),
  qh AS (SELECT item_id, posting_id, n, term, pos, w
         FROM full_match JOIN qt USING (item_id) JOIN hits USING (term, posting_id)),
  ahead AS (SELECT x.item_id, x.posting_id, x.n, x.pos AS b, y.term, min(y.pos) AS a
            FROM qh x JOIN qh y ON x.item_id = y.item_id AND x.posting_id = y.posting_id AND y.pos >= x.pos
            GROUP BY ALL),
  ends AS (SELECT item_id, posting_id, n, b, max(a) AS e FROM ahead GROUP BY ALL HAVING count(*) = n),
  covers AS (SELECT item_id, posting_id, n, e, max(b) AS b FROM ends GROUP BY ALL),
  means AS (SELECT item_id, posting_id, n, b, e, avg(w) AS mean
            FROM (SELECT c.item_id, c.posting_id, c.n, c.b, c.e, q.term, arg_max(q.w, q.pos) AS w
                  FROM covers c JOIN qh q ON c.item_id = q.item_id AND c.posting_id = q.posting_id AND q.pos <= c.e
                  GROUP BY ALL)
            GROUP BY ALL),
  txt AS (SELECT item_id, posting_id,
            row_number() OVER (PARTITION BY item_id
              ORDER BY round(sum(mean / (1 + (e - b + 1 - n))), 9) DESC, posting_id) AS r
          FROM means GROUP BY item_id, posting_id QUALIFY r <= 40),
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
  lv AS (SELECT doc_id, {_letters_sql("line")} AS v FROM lines),
  qv AS (SELECT item_id, {_letters_sql("text")} AS q FROM benchmark),
  best AS (SELECT item_id, doc_id AS posting_id, max(round(list_cosine_similarity(v, q), 12)) AS s
           FROM lv, qv WHERE list_sum(v) > 0 AND list_sum(q) > 0 GROUP BY ALL),
  vec AS (SELECT item_id, posting_id, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, posting_id) AS r
          FROM best QUALIFY r <= 40),
  fused AS (SELECT coalesce(v.item_id, t.item_id) AS item_id, coalesce(v.posting_id, t.posting_id) AS posting_id,
              coalesce(0.4::DOUBLE / (60 + v.r), 0) + coalesce(0.6::DOUBLE / (60 + t.r), 0) AS score, v.r AS near
            FROM vec v FULL JOIN txt t ON v.item_id = t.item_id AND v.posting_id = t.posting_id),
  both_ AS (SELECT item_id, posting_id,
              row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, near NULLS LAST, posting_id) AS r
            FROM fused),
  rankings AS (
    SELECT method, CAST(item_id AS VARCHAR) AS query_id, posting_id, r AS rank
    FROM (SELECT 'text' AS method, * FROM txt UNION ALL SELECT 'semantic', * FROM vec UNION ALL SELECT 'hybrid', * FROM both_)
    WHERE r <= 10),
  truth AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, doc_id AS posting_id
            FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE item_id % 4 <> 0
            UNION ALL SELECT CAST(item_id AS VARCHAR), item_id FROM benchmark WHERE item_id % 4 = 0),
  expected AS (SELECT query_id, count(*) AS expected FROM truth GROUP BY 1),
  methods AS (SELECT unnest(['text', 'semantic', 'hybrid']) AS method),
  judged AS (SELECT m.method, e.query_id, e.expected, r.rank, r.posting_id
             FROM methods m CROSS JOIN expected e
             LEFT JOIN (SELECT r.* FROM rankings r JOIN truth USING (query_id, posting_id)) r
               ON r.method = m.method AND r.query_id = e.query_id)
"""


QUERIES = {
    "match_many": (
        match_many,
        f"""
WITH {POSTINGS_SQL}, {LINKS_SQL},
sizes AS (SELECT posting_id, count(*) AS n FROM links GROUP BY 1),
hits AS (
  SELECT n_name AS profile, n_nationkey AS key, posting_id, count(*) AS m,
         sum(CASE WHEN skill_name LIKE 'red widget %' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) AS lw,
         string_agg(skill_name, '|' ORDER BY skill_name) AS matched_skills
  FROM nation JOIN links ON skill_name IN ('red widget brand#' || (n_nationkey + 1),
                                           'blue bolt brand#' || (n_nationkey + 1))
  GROUP BY ALL)
SELECT profile, posting_id, matched_skills,
       round(least(1, 0.7::DOUBLE * m / n + 0.3::DOUBLE * lw / m), 6) AS score
FROM hits JOIN sizes USING (posting_id) JOIN postings p USING (posting_id)
WHERE m / n::DOUBLE >= 0.6 AND (salary IS NULL OR salary >= 10000 * key)
  AND NOT (salary IS NULL AND coalesce(salary_to < 10000 * key, false))
  AND (key % 2 = 1 OR employment_id = 'O') AND experience_id <> '1-URGENT'""",
    ),
    "match_set_join": (
        match_set_join,
        f"""
WITH {POSTINGS_SQL}, {LINKS_SQL},
sizes AS (SELECT posting_id, count(*) AS n FROM links GROUP BY 1),
held AS (
  SELECT c_custkey AS key, 'red widget brand#' || (c_nationkey + 1) AS skill_name, 1.0::DOUBLE AS w FROM customer
  UNION ALL SELECT c_custkey, 'blue bolt brand#' || (c_custkey % 25 + 1), 0.4::DOUBLE FROM customer
  UNION ALL SELECT c_custkey, 'hot gear brand#' || (c_custkey % 5 + 1), 0.7::DOUBLE FROM customer),
hits AS (
  SELECT key, posting_id, count(*) AS m, sum(w) AS lw,
         string_agg(skill_name, '|' ORDER BY skill_name) AS matched_skills
  FROM held JOIN links USING (skill_name) GROUP BY ALL)
SELECT c_name AS profile, posting_id, matched_skills,
       round(least(1, 0.7::DOUBLE * m / n + 0.3::DOUBLE * lw / m), 6) AS score
FROM hits JOIN sizes USING (posting_id) JOIN postings p USING (posting_id)
JOIN (SELECT *, 20 * greatest(floor(c_acctbal), 0) AS floor_ FROM customer) c ON c_custkey = key
WHERE m / n::DOUBLE >= 0.6 AND (salary IS NULL OR salary >= floor_)
  AND NOT (salary IS NULL AND coalesce(salary_to < floor_, false))
  AND (key % 2 = 1 OR employment_id = 'O') AND experience_id <> '1-URGENT'""",
    ),
    "match_profiles": (
        match_orders,
        f"""
WITH {POSTINGS_SQL}, {LINKS_SQL},
marked AS (
  SELECT posting_id, skill_name, regexp_extract(skill_name, '^(red widget|blue bolt|small ring|green nut) ', 1) AS held,
         skill_name LIKE 'hot gear %' AS gap
  FROM links),
sk AS (
  SELECT posting_id, count(*) AS n, count(*) FILTER (WHERE held <> '') AS m,
         sum(CASE held WHEN 'red widget' THEN 1.0 WHEN 'blue bolt' THEN 0.7 WHEN 'small ring' THEN 0.4
             ELSE 0.0 END::DOUBLE) AS lw,
         string_agg(skill_name, '|' ORDER BY skill_name) FILTER (WHERE held <> '') AS matched,
         string_agg('known_gap=' || skill_name, '|' ORDER BY skill_name) FILTER (WHERE gap) AS gaps
  FROM marked GROUP BY 1),
j AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(m, 0) AS m, lw, coalesce(matched, '') AS matched, gaps,
             6 - CAST(experience_id[1] AS INTEGER) AS lvl
      FROM postings p LEFT JOIN sk USING (posting_id)),
r AS (SELECT *,
        CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE m / n::DOUBLE END AS coverage,
        concat_ws('|',
          CASE WHEN salary < 150000 THEN 'salary_from_low=' || salary END,
          CASE WHEN salary IS NULL AND salary_to < 150000 THEN 'salary_to_low=' || salary_to END,
          CASE WHEN employment_id = 'F' THEN 'employment=F' END,
          CASE WHEN experience_id = '1-URGENT' THEN 'experience=1-URGENT' END,
          CASE WHEN lower(title) LIKE '%urgent p%' THEN 'red_flag= urgent P ' END,
          CASE WHEN lower(title) LIKE '%low o%' THEN 'red_flag=low o' END) AS blockers,
        concat_ws('|',
          CASE WHEN salary IS NULL AND salary_to IS NULL THEN 'salary_unknown' END,
          CASE WHEN lower(title) LIKE '%medium%' THEN 'green_flag=MEDIUM' END,
          gaps,
          CASE WHEN n = 0 THEN 'no_skills_named' END) AS notes
      FROM j)
SELECT posting_id, CASE WHEN blockers <> '' THEN 'no' WHEN coverage >= 0.6 AND n > 0 THEN 'good'
                   ELSE 'stretch' END AS verdict,
       round(least(1, 0.7::DOUBLE * coverage + 0.3::DOUBLE * CASE WHEN m > 0 THEN lw / m ELSE 0 END), 6) AS score,
       matched AS matched_skills, n - m AS n_missing, blockers, notes
FROM r""",
    ),
    "ground_truth": (
        truth,
        """
SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, doc_id AS posting_id
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
    ),
    "retrieval_metrics": (retrieval_metrics, _metric_sql(RANKINGS_SQL)),
    "retrieval_failures": (retrieval_failures, _failure_sql(RANKINGS_SQL)),
    "search_metrics": (search_metrics, _metric_sql(SEARCHES_SQL)),
    "search_failures": (search_failures, _failure_sql(SEARCHES_SQL)),
}
