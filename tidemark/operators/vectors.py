"""Exact and list-based nearest-neighbour search, rank fusion and hybrid search.

Queries stay a table: queries and chunks are packed into blocks inside their tasks, blocks meet
blocks, and each task multiplies the two matrices of a pair of blocks and keeps only its own
best rows per query; no pair of query and chunk ever leaves the task, and nothing runs while a
plan is made.  Texts and names are looked up for the final rows only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import snippet
from tidemark.operators.ranking import best_per_parent, top_k_within
from tidemark.sources.shared import stored

#: Query vectors per block and chunk vectors per block: their scores take 4 MB.
BLOCK_ROWS = 512
PACK_ROWS = 1024

#: Best rows a task holds at most, 24 bytes each.
HELD_RECORDS = 2_000_000

#: Similarities are rounded here, so equal vectors tie whatever block they fall in.
DECIMALS = 12

_NEAREST = (
    "query_id {kind}, posting_id bigint, chunk_index bigint, similarity double"
)


def nearest_order() -> list[Column]:
    """Most similar chunks first, then the lower keys."""
    return [F.desc("similarity"), F.asc("posting_id"), F.asc("chunk_index")]


def _unit_rows(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    if len(flat) != len(column) * dim:
        raise ValueError(f"all vectors must have {dim} components")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(parts: list[np.ndarray], k: int, one_per_posting: bool) -> np.ndarray:
    """First `k` of (similarity, posting, chunk) records in nearest order, ties included."""
    rows = np.concatenate(parts)
    if len(rows) > k and not one_per_posting:
        bound = np.partition(rows["s"], len(rows) - k)[len(rows) - k]
        rows = rows[rows["s"] >= bound]
    rows = rows[np.lexsort((rows["c"], rows["p"], -rows["s"]))]
    if one_per_posting:
        _, first = np.unique(rows["p"], return_index=True)
        rows = rows[np.sort(first)]
    return rows[:k]


_RECORD = np.dtype([("s", "f8"), ("p", "i8"), ("c", "i8")])


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with at most `rows` rows of one list each."""
    lists = batch.column("list_id").to_numpy(zero_copy_only=False)
    order = np.argsort(lists, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
        for start in range(0, len(group), rows):
            yield int(lists[group[0]]), batch.take(pa.array(group[start : start + rows]))


def _finite(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows whose vector has only finite components, and these vectors."""
    column = batch.column("embedding")
    sizes = pc.list_value_length(column)
    dim = pc.max(sizes).as_py() or 0
    vectors = _matrix(column, dim)
    good = np.isfinite(vectors).all(axis=1)
    return batch.filter(pa.array(good)), vectors[good]


def _packed_queries(asked: DataFrame, rows: int) -> DataFrame:
    """Queries of one list as one row per `rows` of them: ids, unit vectors and floors."""
    kind, arrow_kind = _id_type(asked)
    schema = pa.schema(
        [
            ("list_id", pa.int32()),
            ("ids", pa.list_(arrow_kind)),
            ("queries", pa.binary()),
            ("floors", pa.list_(pa.float64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for list_id, part in _slices(batch, rows) if batch.num_rows else ():
                part, vectors = _finite(part)
                values = [
                    [list_id],
                    [part.column("query_id").to_pylist()],
                    [_unit_rows(vectors).tobytes()],
                    [part.column("floor").to_pylist()],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema
                )

    spec = f"list_id int, ids array<{kind}>, queries binary, floors array<double>"
    return asked.select("query_id", "embedding", "list_id", "floor").mapInArrow(run, spec)


def _packed_chunks(rows: DataFrame) -> DataFrame:
    """Chunks of one list as one row per `PACK_ROWS` of them; no shuffle."""
    item = rows.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(item, T.FloatType) else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for list_id, part in _slices(batch, PACK_ROWS) if batch.num_rows else ():
                part, vectors = _finite(part)
                values = {
                    "list_id": pa.array([list_id], pa.int32()),
                    "postings": pa.array([part.column("posting_id").to_numpy().tobytes()], pa.binary()),
                    "chunks": pa.array([part.column("chunk_index").to_numpy().tobytes()], pa.binary()),
                    "vectors": pa.array([vectors.astype(kind).tobytes()], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(values)

    keys = [F.col(c).cast("bigint").alias(c) for c in ("posting_id", "chunk_index")]
    usable = rows.where(F.col("embedding").isNotNull() & keys[0].isNotNull() & keys[1].isNotNull())
    return usable.select(*keys, "embedding", "list_id").mapInArrow(
        run, "list_id int, postings binary, chunks binary, vectors binary"
    ).withColumn("wide", F.lit(np.dtype(kind).itemsize == 8))


def _nearest_in_task(k: int, one_per_posting: bool, kind: pa.DataType):
    """Scorer of one task: its `k` best chunks (or postings by their best chunk) per query.

    A task holds at most `HELD_RECORDS` of its best; beyond that they leave it early, which
    costs rows but changes no result.
    """
    schema = pa.schema(
        [("query_id", kind), ("posting_id", pa.int64()), ("chunk_index", pa.int64()), ("similarity", pa.float64())]
    )

    def out(best: dict) -> pa.RecordBatch:
        ids = [q for q, rows in best.items() for _ in range(len(rows))]
        rows = np.concatenate([*best.values(), np.empty(0, _RECORD)])
        columns = [pa.array(ids, kind), *(pa.array(np.ascontiguousarray(rows[f])) for f in "pcs")]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                ids = row["ids"].as_py()
                posting, chunk = (np.frombuffer(row[c].as_py(), np.int64) for c in ("postings", "chunks"))
                if not ids or not len(posting):
                    continue
                queries = np.frombuffer(row["queries"].as_py(), np.float64).reshape(len(ids), -1)
                flat = np.frombuffer(row["vectors"].as_py(), np.float64 if row["wide"].as_py() else np.float32)
                vectors = flat.astype(np.float64).reshape(len(posting), -1)
                scores = np.round(_unit_rows(vectors) @ queries.T, DECIMALS)
                floors = np.array([-np.inf if f is None else f for f in row["floors"].as_py()])
                for i, q in enumerate(ids):
                    if q in best and len(best[q]) == k:
                        floors[i] = max(floors[i], best[q]["s"][-1])
                for i in np.flatnonzero((scores >= floors).any(axis=0)):
                    worth = scores[:, i] >= floors[i]
                    fresh = np.empty(int(worth.sum()), _RECORD)
                    fresh["s"], fresh["p"], fresh["c"] = scores[worth, i], posting[worth], chunk[worth]
                    parts = [best[ids[i]], fresh] if ids[i] in best else [fresh]
                    best[ids[i]] = _best(parts, k, one_per_posting)
                if len(best) * k > HELD_RECORDS:
                    yield out(best)
                    best = {}
        yield out(best)

    return run


def _id_type(queries: DataFrame) -> tuple[str, pa.DataType]:
    kind = queries.schema["query_id"].dataType.simpleString()
    return kind, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[kind]


def _scored(chunks: DataFrame, asked: DataFrame, k: int, one_per_posting: bool, rows: int) -> DataFrame:
    """Best rows of each task per query.  `asked` has query_id, embedding, floor and list_id;
    chunks without a list meet every query."""
    kind, arrow_kind = _id_type(asked)
    listed = "list_id" in chunks.columns
    packs = _packed_queries(asked.where(F.col("embedding").isNotNull()), rows)
    if listed:
        # the ids of the lists are bounded by the centroids the driver holds
        wanted = F.broadcast(asked.select("list_id").distinct())
        pairs = _packed_chunks(chunks.join(wanted, "list_id", "left_semi")).join(packs, "list_id")
    else:
        # blocks of queries against blocks of chunks: a stated query set meets every chunk
        pairs = _packed_chunks(chunks.withColumn("list_id", F.lit(0))).drop("list_id").crossJoin(packs)
    pairs = pairs.select("ids", "queries", "floors", "postings", "chunks", "vectors", "wide")
    scorer = _nearest_in_task(k, one_per_posting, arrow_kind)
    return pairs.mapInArrow(scorer, _NEAREST.format(kind=kind))


def _ranked(rows: DataFrame, k: int, one_per_posting: bool) -> DataFrame:
    rows = _one_per_posting(rows) if one_per_posting else rows
    return top_k_within(rows, "query_id", nearest_order(), k)


def _floors(found: DataFrame, k: int) -> DataFrame:
    """The k-th best similarity of each query that has k rows: none below it can matter."""
    return found.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))


def nearest_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    centroids: np.ndarray | None = None,
    nprobe: int | None = None,
    block_rows: int = BLOCK_ROWS,
    one_per_posting: bool = False,
    floor_one_in: int | None = None,
) -> DataFrame:
    """The `k` most similar chunks of each query, ranked from 1.

    With `one_per_posting` only the best chunk of a posting counts: the `k` best postings of all
    are among the `k` best of the task that holds their best chunk, so tasks stay independent.
    `queries` has unique `query_id` and `embedding`.  With `centroids`, the chunks carry a `list_id`
    (see `assign_lists`) and each query looks only into the `nprobe` lists nearest to it;
    a table partitioned by `list_id` is then read only in part.

    With `floor_one_in` one chunk in so many, chosen by a hash of its keys, is searched first; the
    k-th similarity found there travels with the query, so later tasks emit nothing below it.
    Vectors that are null or hold null or non-finite components take no part.
    """
    plain = queries.select("query_id", "embedding")
    if centroids is None:
        rows, asked = chunks.drop("list_id"), plain.withColumn("list_id", F.lit(0))
    else:
        near = list_angles(plain, centroids).where(F.col("place") < (nprobe or len(centroids)))
        rows, asked = chunks, plain.join(near.select("query_id", "list_id"), "query_id")
    asked = asked.withColumn("floor", F.lit(None).cast("double"))
    if floor_one_in:
        part = F.pmod(F.xxhash64("posting_id", "chunk_index"), F.lit(floor_one_in)) == 0
        first = _ranked(_scored(rows.where(part), asked, k, one_per_posting, block_rows), k, one_per_posting)
        asked = asked.drop("floor").join(_floors(first, k), "query_id", "left")
    return _ranked(_scored(rows, asked, k, one_per_posting, block_rows), k, one_per_posting)


def _one_per_posting(rows: DataFrame) -> DataFrame:
    columns = ["similarity", "chunk_index"]
    return best_per_parent(rows, ["query_id", "posting_id"], *columns, columns)


def semantic_search(
    chunks: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    min_similarity: float = 0.0,
    over_fetch: int | None = None,
    **nearest,
) -> DataFrame:
    """Best chunk of each of the `limit` nearest postings per query.

    Every posting is judged by its best chunk before the cut.  With `over_fetch` only the nearest
    `limit * over_fetch` chunks are looked at, so fewer than `limit` postings may come back.
    """
    if over_fetch is None:
        best = nearest_chunks(chunks, queries, limit, one_per_posting=True, **nearest)
    else:
        best = _one_per_posting(nearest_chunks(chunks, queries, limit * over_fetch, **nearest))
    near = best.where(F.col("similarity") >= min_similarity).drop("rank")
    return top_k_within(near, "query_id", nearest_order(), limit).select(
        "query_id", "rank", "posting_id", "chunk_index", "similarity"
    )


def with_snippets(hits: DataFrame, chunks: DataFrame, size: int = 400) -> DataFrame:
    """Hits with the head of their chunk's text; a hit without a chunk has an empty one."""
    keys = hits.select("posting_id", "chunk_index").distinct()
    named = chunks.select("posting_id", "chunk_index", "content").join(
        keys, ["posting_id", "chunk_index"], "left_semi"
    )
    texts = named.select("posting_id", "chunk_index", snippet(F.col("content"), size).alias("snippet"))
    return hits.join(texts, ["posting_id", "chunk_index"], "left").withColumn(
        "snippet", F.coalesce("snippet", F.lit(""))
    )


def with_postings(hits: DataFrame, postings: DataFrame, employers: DataFrame) -> DataFrame:
    """Hits with the title, link, date and employer of their posting.

    Hits of postings that are gone are dropped; a posting without a known employer stays.
    """
    wanted = hits.select("posting_id").distinct()
    cards = postings.select("posting_id", "title", "url", "published_at", "employer_id").join(
        wanted, "posting_id", "left_semi"
    )
    named = cards.join(employers.select("employer_id", "employer_name"), "employer_id", "left")
    return hits.join(named, "posting_id")


# --------------------------------------------------------------- list-based search --


def fit_centroids(chunks: DataFrame, k: int, max_iter: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids of `k` lists over all chunk vectors.  `k` bounds what the driver holds."""
    # here, so that workers that score do not hold pyspark.ml, some 30 MB each
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = chunks.where(F.col("embedding").isNotNull()).select(
        array_to_vector("embedding").alias("features")
    )
    model = KMeans(k=k, maxIter=max_iter, seed=seed).fit(vectors)
    return _unit_rows(np.array([np.asarray(c) for c in model.clusterCenters()], dtype=np.float64))


def assign_lists(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Chunks with the `list_id` of their nearest centroid; a narrow Arrow pass.

    Written with `partitionBy("list_id")`, a probe reads only its lists.  A list may hold any
    share of the rows: it is split over files and tasks like any other data.
    """
    spec = T.StructType([*chunks.schema.fields, T.StructField("list_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            lists = np.zeros(rows, dtype=np.int32)
            if rows:
                column = batch.column("embedding")
                known = column.is_valid().to_numpy(zero_copy_only=False)
                vectors = _matrix(column.filter(pa.array(known)), centroids.shape[1])
                lists[known] = np.argmax(vectors @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists)], names=[*batch.schema.names, "list_id"]
            )

    return chunks.mapInArrow(run, spec)


def _angles(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """Rows with a usable vector, and the angle of each to each centroid."""
    kept, vectors = _finite(batch.filter(batch.column("embedding").is_valid()))
    if not len(vectors):
        return kept, np.empty((0, len(centroids)))
    return kept, np.arccos(np.clip(_unit_rows(vectors) @ _unit_rows(centroids).T, -1, 1))


def list_angles(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """A row per query and list: its `place` from 0 for the nearest centroid, and the angle."""
    kind, arrow_kind = _id_type(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, angles = _angles(batch, centroids)
            order = np.argsort(np.round(angles, DECIMALS), axis=1, kind="stable")
            ids = kept.column("query_id").take(pa.array(np.repeat(np.arange(len(angles)), len(centroids))))
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": ids.cast(arrow_kind),
                    "list_id": pa.array(order.ravel().astype(np.int32)),
                    "place": pa.array(np.tile(np.arange(len(centroids), dtype=np.int32), len(angles))),
                    "angle": pa.array(np.take_along_axis(angles, order, axis=1).ravel()),
                }
            )

    spec = f"query_id {kind}, list_id int, place int, angle double"
    return queries.select("query_id", "embedding").mapInArrow(run, spec)


def list_radii(listed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The largest angle between a list's centroid and one of its chunks: one row per used list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest: dict[int, float] = {}
        for batch in batches:
            kept, angles = _angles(batch, centroids)
            lists = kept.column("list_id").to_numpy(zero_copy_only=False)
            for one in np.unique(lists):
                widest[int(one)] = max(widest.get(int(one), 0.0), float(angles[lists == one, one].max()))
        yield pa.RecordBatch.from_pydict(
            {"list_id": pa.array(widest.keys(), pa.int32()), "radius": pa.array(widest.values(), pa.float64())}
        )

    found = listed.select("list_id", "embedding").mapInArrow(run, "list_id int, radius double")
    return found.groupBy("list_id").agg(F.max("radius").alias("radius"))


def stopped_search(
    listed: DataFrame,
    centroids: np.ndarray,
    radii: DataFrame,
    queries: DataFrame,
    k: int,
    nprobe: int = 1,
    one_per_posting: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The exact `k` best chunks of each query, reading only lists that can hold one of them.

    The `nprobe` nearest lists give each query a floor, its k-th similarity so far.  By the triangle
    inequality of angles no chunk of a list is nearer than the angle to its centroid less the
    list's radius; lists that cannot reach the floor so are left unread.  A query with fewer than `k`
    chunks so far reads every list.  `lists_read` and `lists` say how many of the used lists a
    query read.  The first pass is stored in the shared folder.
    """
    plain = queries.select("query_id", "embedding")
    # one row per list: bounded by the centroids the driver holds
    reach = list_angles(plain, centroids).join(F.broadcast(radii), "list_id").withColumn(
        "reach", F.cos(F.greatest(F.col("angle") - F.col("radius"), F.lit(0.0)))
    )
    nearest = Window.partitionBy("query_id").orderBy("place")
    reach = reach.withColumn("place", F.row_number().over(nearest) - 1)
    first_lists = reach.where(F.col("place") < nprobe).select("query_id", "list_id")
    asked = plain.join(first_lists, "query_id").withColumn("floor", F.lit(None).cast("double"))
    first = stored(
        _ranked(_scored(listed, asked, k, one_per_posting, block_rows), k, one_per_posting), "probe"
    )
    more = reach.where(F.col("place") >= nprobe).join(_floors(first, k), "query_id", "left")
    # similarities are rounded; the slack keeps a list whose bound is the floor itself
    more = more.where(F.col("floor").isNull() | (F.col("reach") >= F.col("floor") - 1e-9))
    rest = _scored(listed, plain.join(more.select("query_id", "list_id", "floor"), "query_id"), k, one_per_posting, block_rows)
    both = first.drop("rank").unionByName(rest)
    further = more.groupBy("query_id").agg(F.count(F.lit(1)).alias("further"))
    read = reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("lists")).join(further, "query_id", "left").select(
        "query_id",
        (F.least(F.lit(nprobe), F.col("lists")) + F.coalesce("further", F.lit(0))).alias("lists_read"),
        "lists",
    )
    return _ranked(both, k, one_per_posting).join(read, "query_id")


def write_lists(listed: DataFrame, path: str, splits: int = 8) -> None:
    """Store chunks by list, so that a probe reads only the folders of its lists.

    Each list is salted into `splits` parts: a list with a third of all rows is written by
    that many tasks, and no list is scattered over as many files as there are tasks.
    """
    salt = F.pmod(F.xxhash64("posting_id", "chunk_index"), F.lit(splits))
    listed.repartition("list_id", salt).write.mode("overwrite").partitionBy("list_id").parquet(path)


def approx_semantic_search(
    listed: DataFrame, centroids: np.ndarray, queries: DataFrame, nprobe: int, **search
) -> DataFrame:
    """`semantic_search` over the `nprobe` nearest lists; probing all lists makes it exact."""
    return semantic_search(listed, queries, centroids=centroids, nprobe=nprobe, **search)


# ------------------------------------------------------------------------- fusion --


def rrf(rankings: Sequence[DataFrame], weights: Sequence[float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of `(query_id, posting_id, rank)` frames.

    The score of a posting is the sum of weight / (k + rank) over the lists that hold it,
    rounded so that equal sums tie.
    """
    if len(rankings) != len(weights):
        raise ValueError("one weight per ranking is needed")
    parts = [
        r.select("query_id", "posting_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part"))
        for r, w in zip(rankings, weights)
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("query_id", "posting_id")
        .agg(F.round(F.sum("part"), DECIMALS).alias("score"))
    )


def hybrid_search(
    text_ranks: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    limit: int = 10,
    semantic_weight: float = 0.5,
    depth: int | None = None,
    k: int = 60,
) -> DataFrame:
    """Text and vector search fused by rank, `limit` postings per query.

    `text_ranks` has `(query_id, posting_id, rank)` with 1 for the best.  The first `depth` of
    both lists are fused, four times `limit` unless given.  A posting found by text alone has
    similarity 0 and chunk -1.  Ties: nearer in the vector list, then the lower id.
    """
    depth = 4 * limit if depth is None else depth
    near = semantic_search(chunks, queries, limit=depth)
    return fuse_hits(text_ranks.where(F.col("rank") <= depth), near, limit, semantic_weight, k)


def fuse_hits(
    text_ranks: DataFrame, near: DataFrame, limit: int = 10, semantic_weight: float = 0.5, k: int = 60
) -> DataFrame:
    """Fusion by rank of a text list and hits of `semantic_search`, each read once: similarity and
    chunk travel through the grouping that adds up the parts of `rrf`."""
    weights = {"near": semantic_weight, "text": 1 - semantic_weight}

    def part(rows: DataFrame, name: str) -> DataFrame:
        own = (lambda c: F.col(c)) if name == "near" else (lambda c: F.lit(None))
        return rows.select(
            "query_id",
            "posting_id",
            (F.lit(float(weights[name])) / (k + F.col("rank"))).alias("part"),
            own("similarity").cast("double").alias("similarity"),
            own("chunk_index").cast("bigint").alias("chunk_index"),
            own("rank").cast("int").alias("_near"),
        )

    fused = (
        part(near, "near")
        .unionByName(part(text_ranks, "text"))
        .groupBy("query_id", "posting_id")
        .agg(
            F.round(F.sum("part"), DECIMALS).alias("score"),
            *[F.max(c).alias(c) for c in ("similarity", "chunk_index", "_near")],
        )
    )
    order = [F.desc("score"), F.asc_nulls_last("_near"), F.asc("posting_id")]
    return top_k_within(fused, "query_id", order, limit).select(
        "query_id",
        "rank",
        "posting_id",
        "score",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
    )
