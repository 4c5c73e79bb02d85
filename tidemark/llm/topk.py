"""Exact top-k by inner product: vectors grouped by length, pruned per group, then verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Rows of a shard of vectors and of a block of queries, about.
SHARD_ROWS, BLOCK_ROWS = 40_000, 8_000
#: Vectors in a length bucket of a shard, and queries multiplied at once.
BUCKET, AT_ONCE = 1024, 512
#: Local cosine from which pruning by coordinates pays.
STEEP = 0.75
#: Coordinates looked at when pruning by them.
FOCUS = 4

_FOUND = pa.schema(
    [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]
)
_BIG = 2**63 - 1


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v, length2): components as floor(scale * x), without null, non-finite or id-less
    rows.  length2 is the squared length as a double."""
    finite = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
    )
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return (
        vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite)
        .select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
        .withColumn(
            "length2",
            F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")),
        )
    )


class Matrix:
    """Vectors in rows, padded with zeros to one width."""

    def __init__(self, table: pa.Table, width: int):
        column = table.column("v").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = table.column("vec_id").to_numpy().astype(np.int64)
        self.rows = np.zeros((len(sizes), width), np.int64)
        if len(flat):
            row = np.repeat(np.arange(len(sizes)), sizes)
            self.rows[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat


def _width(table: pa.Table) -> int:
    column = table.column("v").combine_chunks()
    return int(np.diff(column.offsets.to_numpy()).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, at most _BIG either way."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top < 2**24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object)
    return np.clip(whole, -_BIG - 1, _BIG).astype(np.int64)


class Best:
    """The k best of each query so far: higher score first, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.vec = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.floor = np.full(n, -_BIG - 1, np.int64)
        self.full = np.zeros(n, bool)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (
            np.concatenate(x)
            for x in ((self.query, query), (self.vec, vec), (self.score, score))
        )
        order = np.lexsort((vec, ~score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        counts = np.bincount(self.query, minlength=len(self.floor))
        self.full = counts >= self.k
        last = np.cumsum(counts) - 1
        self.floor[self.full] = self.score[last[self.full]]


def _near(rows: np.ndarray, size: np.ndarray, query: np.ndarray, length: float, cosine: float,
          by_coordinate: list[np.ndarray]) -> np.ndarray:
    """Rows of a bucket whose leading coordinates allow the cosine with the query.

    With unit vectors q and p and a cosine of at least c, each coordinate p_f lies within
    q_f c - r and q_f c + r, r = sqrt((1 - c^2)(1 - q_f^2)), or reaches to the pole that q_f is
    nearer to than c.
    """
    unit = query / length
    left = np.arange(len(rows))
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        q = min(max(unit[f], -1.0), 1.0)
        reach = np.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q * q)))
        low = -1.0 if q < -cosine else q * cosine - reach
        high = 1.0 if q > cosine else q * cosine + reach
        p = by_coordinate[f][left]
        left = left[(p >= low - 1e-9) & (p <= high + 1e-9)]
    return left


def retrieve(vectors: Matrix, queries: Matrix, k: int) -> Best:
    """The k best vectors of a shard for each query, its own id apart.

    Buckets go by falling length.  A query's score so far over (its length x the bucket's largest
    length) is the local cosine threshold: over one, the bucket is skipped; if steep, rows are
    pruned by coordinates; else by their own length.  What is left is multiplied out.
    """
    size = np.sqrt((vectors.rows.astype(float) ** 2).sum(axis=1))
    order = np.lexsort((vectors.ids, -size))
    rows, ids, size = vectors.rows[order], vectors.ids[order], size[order]
    q_size = np.sqrt((queries.rows.astype(float) ** 2).sum(axis=1))
    best = Best(len(queries.ids), k)
    for begin in range(0, len(ids), BUCKET):
        part = slice(begin, begin + BUCKET)
        most, least = size[begin], size[part][-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(best.full, best.floor / (q_size * most), -np.inf)
        # a zero length leaves no cosine: such queries and buckets are multiplied out
        local = np.where((q_size > 0) & (most > 0), local, -np.inf)
        live = np.flatnonzero(~(local > 1 + 1e-9))
        steep = live[local[live] >= STEEP] if least > 0 else live[:0]
        flat = np.setdiff1d(live, steep, assume_unique=True)
        for at in range(0, len(flat), AT_ONCE):
            chosen = flat[at : at + AT_ONCE]
            need = np.where(best.full[chosen] & (q_size[chosen] > 0),
                            best.floor[chosen] / np.maximum(q_size[chosen], 1e-300), -np.inf)
            # lengths fall, so the rows long enough for any of the queries come first
            end = int(np.searchsorted(-size[part], -(need.min() * (1 - 1e-9)), side="right"))
            end = end if need.min() > 0 else len(size[part])
            _verify(best, queries, chosen, rows[part][:end], ids[part][:end])
        if len(steep):
            coordinates = list((rows[part] / size[part][:, None]).T)
            for q in steep:
                near = _near(rows[part], size[part], queries.rows[q].astype(float), q_size[q],
                             min(local[q] * (1 - 1e-9), 1.0), coordinates)
                _verify(best, queries, np.array([q]), rows[part][near], ids[part][near])
    return best


def _verify(best: Best, queries: Matrix, chosen: np.ndarray, rows: np.ndarray, ids: np.ndarray):
    """Multiply out and keep what can be among the k best."""
    if not len(ids):
        return
    score = products(queries.rows[chosen], rows)
    own = queries.ids[chosen][:, None] == ids[None, :]
    score[own] = -_BIG - 1
    bar = best.floor[chosen]
    if len(ids) > best.k:
        cut = np.partition(score, len(ids) - best.k, axis=1)[:, len(ids) - best.k]
        bar = np.maximum(bar, cut)
    q, v = np.nonzero((score >= bar[:, None]) & ~own)
    best.add(chosen[q], ids[v], score[q, v])


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest integer inner
    product for each row of `queries`, its own id apart; ties go to the smaller id.

    Vectors are sorted into buckets by length; a bucket of many rows, even if all have one length,
    is dealt over shards by hash.  Queries are dealt into blocks.  Each (shard, block) meets in one
    task of bounded size, which prunes bucket by bucket and returns k rows a query.

    Null vectors, vectors with null or non-finite components and rows without id take no part;
    shorter vectors count as padded with zeros; components and scores are held to the range of a
    long; repeated rows are candidates each; of queries with one id the smallest vector is asked;
    no vectors give no rows.
    """
    base = stored(quantised(vectors, vec_id, vector, scale), "vectors")
    asked = quantised(queries, vec_id, vector, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked, "queries")
    bounds = base.select(
        F.count("*").alias("n"),
        F.percentile_approx("length2", [i / 16 for i in range(1, 16)], 10_000).alias("cuts"),
    ).first()
    n_blocks = max(1, -(-asked.count() // block_rows))
    cuts = sorted(set(bounds["cuts"] or []))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("length2") > c).cast("int")
    base = base.withColumn("bucket", bucket)
    shards, first = {}, 0
    for r in base.groupBy("bucket").count().orderBy("bucket").collect():
        parts = max(1, -(-r["count"] // shard_rows))
        shards[r["bucket"]] = (first, parts)
        first += parts
    if not shards:
        return base.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score bigint"
        )
    pair = F.lit(None).cast("struct<first:int,parts:int>")
    for b, (at, parts) in shards.items():
        pair = F.when(
            F.col("bucket") == b, F.struct(F.lit(at).alias("first"), F.lit(parts).alias("parts"))
        ).otherwise(pair)
    spread = F.xxhash64("vec_id", "v")
    left = base.select(
        "vec_id", "v",
        (pair["first"] + F.pmod(spread, pair["parts"])).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
    )
    right = asked.select(
        "vec_id", "v",
        F.explode(F.sequence(F.lit(0), F.lit(first - 1))).alias("shard"),
        F.pmod(spread, F.lit(n_blocks)).cast("int").alias("block"),
    )

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        if not some.num_rows or not others.num_rows:
            return _FOUND.empty_table()
        width = max(_width(some), _width(others))
        asking = Matrix(others, width)
        best = retrieve(Matrix(some, width), asking, k)
        return pa.table([asking.ids[best.query], best.vec, best.score], schema=_FOUND)

    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")
    )
    ranked = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """The five best of all rows for every row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
WHERE rank <= 5
"""
