"""Vector search, rank fusion and hybrid search over the embeddings and documents.

The query vectors are the mean vectors of the labels, so they are derived from the whole
table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vector import cosine
from tidemark.operators import fulltext as ft
from tidemark.operators import vectors as v
from tidemark.operators.ranking import best_per_parent, rank_within, top_k_within
from tidemark.plans import standin as s
from tidemark.plans.text import HITS_SQL, index, rank_sql

#: Search words of each label, used by the fused searches.
LABEL_WORDS = {
    0: ["the", "of"], 1: ["la", "de"], 2: ["und"], 3: ["and", "in"], 4: ["is"], 5: ["der", "die"],
    6: ["los", "que"], 7: ["for", "with"], 8: ["a", "to"], 9: ["le", "les"],
}


def label_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per label as `(query_id, embedding)`: a map-side combined average per place."""
    vectors = s.table(spark, d, "embeddings").select(
        F.col("label").alias("query_id"), F.posexplode("embedding").alias("place", "x")
    )
    means = vectors.groupBy("query_id", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "x")))["x"].alias("embedding")
    )


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Embedding rows as the only chunk of the document with their number."""
    return s.chunks(spark, d).select(
        F.col("chunk_index").alias("posting_id"), F.lit(0).alias("chunk_index"), "content", "embedding"
    )


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    near = v.nearest_chunks(s.chunks(spark, d), label_means(spark, d), 10)
    return near.withColumn("similarity", F.round("similarity", 6))


def native_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every chunk to the mean vector of its own label, by expressions."""
    own = s.chunks(spark, d).join(
        label_means(spark, d).withColumnRenamed("embedding", "mean"),
        F.col("posting_id") == F.col("query_id"),
    )
    near = F.round(cosine(F.col("embedding"), F.col("mean")), 6)
    return own.select("chunk_index", near.alias("similarity"))


def best_parent(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk per label by its first component, rounded so that some tie."""
    scored = s.chunks(spark, d).withColumn(
        "score", F.round(F.element_at("embedding", 1).cast("double"), 2)
    )
    return best_per_parent(scored, ["posting_id"], "score", "chunk_index", ["score", "chunk_index"])


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    chunks = s.chunks(spark, d)
    hits = v.semantic_search(
        chunks, label_means(spark, d), limit=5, min_similarity=0.05, over_fetch=4
    )
    out = v.with_snippets(hits, chunks, 7)
    return out.select(
        "query_id", "rank", "posting_id", "chunk_index", F.round("similarity", 6).alias("similarity"), "snippet"
    )


def exact_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk of every label for every query, cut after the collapse."""
    hits = v.semantic_search(s.chunks(spark, d), label_means(spark, d), limit=5)
    return hits.withColumn("similarity", F.round("similarity", 6))


def approx_full(spark: SparkSession, d: str) -> DataFrame:
    """List-based search probing every list: must equal the exact search."""
    chunks = s.chunks(spark, d)
    centroids = v.fit_centroids(chunks, k=8)
    hits = v.approx_semantic_search(
        v.assign_lists(chunks, centroids), centroids, label_means(spark, d), nprobe=8,
        limit=5, min_similarity=0.05, over_fetch=4,
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


def approx_part(spark: SparkSession, d: str) -> DataFrame:
    """Two of the lists around the label means, which bound the lists by the labels."""
    means = label_means(spark, d)
    rows = [r["embedding"] for r in means.orderBy("query_id").collect()]
    centroids = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    hits = v.approx_semantic_search(
        v.assign_lists(s.chunks(spark, d), centroids), centroids, means, nprobe=2, limit=5
    )
    return hits.withColumn("similarity", F.round("similarity", 6))


def stopped(spark: SparkSession, d: str) -> DataFrame:
    """Exact search that leaves lists unread which cannot hold one of the ten best; the lists
    lie around the label means, which bound them by the labels."""
    means = label_means(spark, d)
    rows = [r["embedding"] for r in means.orderBy("query_id").collect()]
    centroids = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    listed = v.assign_lists(s.chunks(spark, d), centroids)
    hits = v.stopped_search(listed, centroids, v.list_radii(listed, centroids), means, 10)
    return hits.withColumn("similarity", F.round("similarity", 6))


def text_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranked text hits per label."""
    ranks = ft.text_rank(index(spark, d), {str(k): w for k, w in LABEL_WORDS.items()})
    hits = ranks.select(F.col("query_id").cast("int"), "posting_id", F.col("rank").alias("score"))
    return rank_within(hits, "query_id", [F.desc("score"), F.asc("posting_id")])


def fuse(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two top lists per source: the longest documents and the first English ones."""
    docs = s.table(spark, d, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("posting_id"), "n_chars", "lang"
    )
    by_length = top_k_within(docs, "query_id", [F.desc("n_chars"), F.asc("posting_id")], 50)
    english = top_k_within(docs.where(F.col("lang") == "en"), "query_id", [F.asc("posting_id")], 50)
    return v.rrf([by_length, english], [0.7, 0.3]).withColumn("score", F.round("score", 9))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    hits = v.hybrid_search(
        text_ranks(spark, d), document_chunks(spark, d), label_means(spark, d), limit=10,
        semantic_weight=0.4,
    )
    return hits.withColumn("similarity", F.round("similarity", 6)).withColumn(
        "score", F.round("score", 9)
    )


def _document_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as postings; the customer with the number of the text's length employs."""
    return s.document_texts(spark, d).select(
        "posting_id",
        "title",
        F.col("lang").alias("url"),
        F.expr("timestampadd(MINUTE, n_chars, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("published_at"),
        F.col("n_chars").alias("employer_id"),
    )


def _named(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """Hits with posting, employer and snippet columns."""
    cards = v.with_postings(hits, _document_postings(spark, d), s.employers(spark, d))
    return v.with_snippets(cards, document_chunks(spark, d), 7).select(
        "query_id", "rank", "posting_id", F.round("similarity", 6).alias("similarity"), "title", "url",
        "published_at", "employer_name", "snippet",
    )


def semantic_hits(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents of each label with their columns."""
    return _named(
        spark, d, v.semantic_search(document_chunks(spark, d), label_means(spark, d), limit=20)
    )


def hybrid_hits(spark: SparkSession, d: str) -> DataFrame:
    """A hundred hybrid hits of each label with their columns."""
    hits = v.hybrid_search(
        text_ranks(spark, d), document_chunks(spark, d), label_means(spark, d), limit=100,
        semantic_weight=0.4,
    )
    return _named(spark, d, hits)


def semantic_complete(spark: SparkSession, d: str) -> DataFrame:
    """One posting owns every chunk that is not of label 7, yet all postings asked for are found."""
    chunks = s.chunks(spark, d).withColumn(
        "posting_id", F.when(F.col("posting_id") == 7, F.col("chunk_index")).otherwise(-1)
    )
    hits = v.semantic_search(chunks, label_means(spark, d), limit=15, min_similarity=-1.0)
    return hits.withColumn("similarity", F.round("similarity", 6))


def _whole_rank(sql: str) -> str:
    return f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({sql})"


MEANS_SQL = """
  comp AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label AS query_id, list(x ORDER BY i) AS q
            FROM (SELECT label, i, avg(x) AS x FROM comp GROUP BY ALL) GROUP BY label),
  sims AS (SELECT query_id, CAST(label AS BIGINT) AS posting_id, vec_id AS chunk_index,
                  round(list_cosine_similarity(embedding::DOUBLE[], q), 12) AS s
           FROM embeddings, means),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, posting_id, chunk_index) AS rank
           FROM sims)
"""

_KNN_SQL = f"""
WITH {MEANS_SQL},
fetched AS (SELECT * FROM near WHERE rank <= 20 AND s >= 0.05),
best AS (SELECT query_id, posting_id, chunk_index, s FROM fetched
         QUALIFY row_number() OVER (PARTITION BY query_id, posting_id ORDER BY s DESC, chunk_index) = 1)
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, posting_id, chunk_index) AS rank
       {{more}}
FROM best QUALIFY rank <= 5"""

_TEXT_SQL = " UNION ALL ".join(rank_sql(str(k), w) for k, w in LABEL_WORDS.items())

_CARDS_SQL = """
SELECT h.query_id, h.rank, h.posting_id, round(h.s, 6) AS similarity,
       string_split(d.text, chr(10))[1] AS title, d.lang AS url,
       TIMESTAMP '2024-01-01' + to_minutes(d.n_chars) AS published_at, c_name AS employer_name,
       CASE WHEN e.vec_id IS NULL THEN '' WHEN length('chunk ' || e.vec_id) <= 7 THEN 'chunk ' || e.vec_id
            ELSE substr('chunk ' || e.vec_id, 1, 7) || '…' END AS snippet
FROM found h JOIN documents d ON d.doc_id = h.posting_id LEFT JOIN customer ON c_custkey = d.n_chars
LEFT JOIN embeddings e ON e.vec_id = h.posting_id AND h.chunk_index >= 0"""

QUERIES = {
    "cosine_topk": (
        cosine_topk,
        _whole_rank(
            f"""
WITH {MEANS_SQL}
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity, rank FROM near WHERE rank <= 10"""
        ),
    ),
    "cosine_native": (
        native_cosine,
        f"""
WITH {MEANS_SQL}
SELECT chunk_index, round(s, 6) AS similarity FROM sims WHERE query_id = posting_id""",
    ),
    "best_per_parent": (
        best_parent,
        """
SELECT CAST(label AS BIGINT) AS posting_id, round(embedding[1]::DOUBLE, 2) AS score, vec_id AS chunk_index
FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 2) DESC, vec_id) = 1""",
    ),
    "knn_batch": (
        knn_batch,
        _whole_rank(_KNN_SQL).format(
            more=""", CASE WHEN length('chunk ' || chunk_index) <= 7 THEN 'chunk ' || chunk_index
              ELSE substr('chunk ' || chunk_index, 1, 7) || '…' END AS snippet"""
        ),
    ),
    "knn_exact_collapse": (
        exact_collapse,
        _whole_rank(f"""
WITH {MEANS_SQL},
best AS (SELECT query_id, posting_id, max(s) AS s, arg_max(chunk_index, (s, -chunk_index)) AS chunk_index
         FROM sims GROUP BY 1, 2)
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, posting_id, chunk_index) AS rank
FROM best WHERE s >= 0 QUALIFY rank <= 5"""),
    ),
    "approx_knn_full_probe": (approx_full, _whole_rank(_KNN_SQL).format(more="")),
    "approx_knn": (
        approx_part,
        _whole_rank(f"""
WITH {MEANS_SQL},
lists AS (SELECT vec_id, arg_max(m.query_id, list_cosine_similarity(embedding::DOUBLE[], m.q)) AS list
          FROM embeddings, means m GROUP BY vec_id),
probes AS (SELECT a.query_id, b.query_id AS list FROM means a, means b
           QUALIFY row_number() OVER (PARTITION BY a.query_id
             ORDER BY list_cosine_similarity(a.q, b.q) DESC, b.query_id) <= 2),
best AS (SELECT query_id, posting_id, max(s) AS s, arg_max(chunk_index, (s, -chunk_index)) AS chunk_index
         FROM sims JOIN lists ON lists.vec_id = chunk_index JOIN probes USING (query_id, list) GROUP BY 1, 2)
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, posting_id, chunk_index) AS rank
FROM best WHERE s >= 0 QUALIFY rank <= 5"""),
    ),
    "approx_stopped": (
        stopped,
        _whole_rank(f"""
WITH {MEANS_SQL},
far AS (SELECT vec_id, m.query_id AS list, list_cosine_similarity(embedding::DOUBLE[], m.q) AS c
        FROM embeddings, means m),
lists AS (SELECT vec_id, arg_max(list, c) AS list, acos(least(max(c), 1)) AS angle FROM far GROUP BY vec_id),
radii AS (SELECT list, max(angle) AS radius FROM lists GROUP BY list),
reach AS (SELECT a.query_id, list, acos(greatest(-1, least(1, list_cosine_similarity(a.q, b.q)))) AS angle, radius,
            row_number() OVER (PARTITION BY a.query_id ORDER BY list_cosine_similarity(a.q, b.q) DESC, list) AS place
          FROM means a, radii JOIN means b ON b.query_id = list),
own AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS r
        FROM sims JOIN lists ON lists.vec_id = chunk_index JOIN reach USING (query_id, list) WHERE place = 1),
floors AS (SELECT query_id, s AS floor FROM own WHERE r = 10),
reads AS (SELECT query_id, count(*) AS lists,
            count(*) FILTER (WHERE place = 1 OR floor IS NULL OR cos(greatest(angle - radius, 0)) >= floor - 1e-9) AS lists_read
          FROM reach LEFT JOIN floors USING (query_id) GROUP BY query_id)
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity, rank, lists_read, lists
FROM near JOIN reads USING (query_id) WHERE rank <= 10"""),
    ),
    "rrf": (
        fuse,
        """
WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r
           FROM documents QUALIFY r <= 50),
b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
      FROM documents WHERE lang = 'en' QUALIFY r <= 50)
SELECT coalesce(a.source, b.source) AS query_id, coalesce(a.doc_id, b.doc_id) AS posting_id,
       round(coalesce(0.7::DOUBLE / (60 + a.r), 0) + coalesce(0.3::DOUBLE / (60 + b.r), 0), 9) AS score
FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    ),
    "semantic_complete": (
        semantic_complete,
        _whole_rank(f"""
WITH {MEANS_SQL},
own AS (SELECT query_id, CASE WHEN posting_id = 7 THEN chunk_index ELSE -1 END AS posting_id, chunk_index, s FROM sims),
best AS (SELECT query_id, posting_id, max(s) AS s, arg_max(chunk_index, (s, -chunk_index)) AS chunk_index
         FROM own GROUP BY 1, 2)
SELECT query_id, posting_id, chunk_index, round(s, 6) AS similarity,
       row_number() OVER (PARTITION BY query_id ORDER BY s DESC, posting_id, chunk_index) AS rank
FROM best QUALIFY rank <= 15"""),
    ),
    "semantic_hits": (
        semantic_hits,
        _whole_rank(f"""
WITH {MEANS_SQL},
found AS (SELECT query_id, chunk_index AS posting_id, 0 AS chunk_index, s,
           row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_index) AS rank
         FROM sims WHERE s >= 0 QUALIFY rank <= 20)
{_CARDS_SQL}"""),
    ),
    "hybrid_hits": (
        hybrid_hits,
        _whole_rank(f"""
WITH {HITS_SQL}, {MEANS_SQL},
txt AS (SELECT CAST(query_id AS INTEGER) AS query_id, posting_id,
          row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, posting_id) AS r
        FROM ({_TEXT_SQL})),
vec AS (SELECT query_id, chunk_index AS posting_id, s,
          row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_index) AS r
        FROM sims WHERE s >= 0),
fused AS (
  SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.posting_id, t.posting_id) AS posting_id,
         coalesce(0.4::DOUBLE / (60 + v.r), 0) + coalesce(0.6::DOUBLE / (60 + t.r), 0) AS score,
         coalesce(v.s, 0) AS similarity, CAST(CASE WHEN v.r IS NULL THEN -1 ELSE 0 END AS BIGINT) AS chunk_index, v.r AS near
  FROM (SELECT * FROM vec WHERE r <= 400) v
  FULL JOIN (SELECT * FROM txt WHERE r <= 400) t
    ON v.query_id = t.query_id AND v.posting_id = t.posting_id),
found AS (SELECT query_id, posting_id, chunk_index, similarity AS s,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, near NULLS LAST, posting_id) AS rank
         FROM fused QUALIFY rank <= 100)
{_CARDS_SQL}"""),
    ),
    "hybrid": (
        hybrid,
        _whole_rank(f"""
WITH {HITS_SQL}, {MEANS_SQL},
txt AS (SELECT CAST(query_id AS INTEGER) AS query_id, posting_id,
          row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9) DESC, posting_id) AS r
        FROM ({_TEXT_SQL})),
vec AS (SELECT query_id, chunk_index AS posting_id, s,
          row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_index) AS r
        FROM sims WHERE s >= 0),
fused AS (
  SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.posting_id, t.posting_id) AS posting_id,
         coalesce(0.4::DOUBLE / (60 + v.r), 0) + coalesce(0.6::DOUBLE / (60 + t.r), 0) AS score,
         coalesce(v.s, 0) AS similarity, CAST(CASE WHEN v.r IS NULL THEN -1 ELSE 0 END AS BIGINT) AS chunk_index, v.r AS near
  FROM (SELECT * FROM vec WHERE r <= 40) v
  FULL JOIN (SELECT * FROM txt WHERE r <= 40) t
    ON v.query_id = t.query_id AND v.posting_id = t.posting_id)
SELECT query_id, posting_id, round(score, 9) AS score, round(similarity, 6) AS similarity, chunk_index,
       row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, near NULLS LAST, posting_id) AS rank
FROM fused QUALIFY rank <= 10"""),
    ),
}
