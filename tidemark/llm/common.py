"""Helpers of the operators in this folder: Arrow texts as numbered words, hot keys, shared tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 2_000_000

_ASCII = np.arange(128, dtype=np.uint8)
_LOWER = np.where((_ASCII >= 65) & (_ASCII <= 90), _ASCII + 32, _ASCII).astype(np.uint8)
_OTHER = np.arange(128, 256, dtype=np.uint8)

#: Byte tables: A-Z lower-cased, bytes outside words turned into 0.
ALNUM = np.concatenate(
    [
        np.where(
            ((_LOWER >= 48) & (_LOWER <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)), _LOWER, 0
        ).astype(np.uint8),
        _OTHER,
    ]
)
#: As ALNUM for words between white space: a NUL byte is part of a word there, so white space is 0
#: and NUL becomes 255, a byte that UTF-8 never holds.
SPACED = np.concatenate(
    [
        np.where(
            (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13)), 0, np.where(_ASCII == 0, 255, _LOWER)
        ).astype(np.uint8),
        _OTHER,
    ]
)


class Words:
    """The words of a run of texts: `codes` numbers them, `vocabulary` holds the distinct ones,
    and text i has the words `bounds[i]` to `bounds[i + 1]`."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, vocabulary: pa.Array):
        self.codes, self.bounds, self.vocabulary = codes, bounds, vocabulary

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each distinct word."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter(
            (digest(w, seed) for w in self.vocabulary.to_pylist()),
            dtype=np.uint64,
            count=len(self.vocabulary),
        )


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins and ends; null is empty."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, table: np.ndarray = ALNUM) -> Words:
    """Cut texts into words with a byte table and number them."""
    flat, at = bytes_of(texts)
    mapped = table[flat]
    inside = mapped != 0
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(
        pa.binary(),
        len(starts),
        [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(mapped[inside]))],
    )
    coded = words.dictionary_encode()
    return Words(
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        np.searchsorted(starts, at),
        coded.dictionary,
    )


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut an array of texts into runs of about `limit` bytes."""
    _, at = bytes_of(texts)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield texts.slice(begin, end - begin)
        begin = end


def text_udf(work: Callable[[], Callable[..., pa.Array]], kind: str, extra: int = 0):
    """A column function over a text column and `extra` others: `work()` sets up a task, what it
    returns maps a slice of the columns to as many results.  Evaluated once per row."""

    def pieces(step, columns):
        done, begin = [], 0
        for piece in slices(columns[0]):
            done.append(step(piece, *(c.slice(begin, len(piece)) for c in columns[1:])))
            begin += len(piece)
        return pa.concat_arrays(done) if done else step(*columns)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step = work()
        for batch in batches:
            yield pieces(step, (batch,))

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        step = work()
        for batch in batches:
            yield pieces(step, batch)

    run = several if extra else one
    kinds = tuple[pa.Array, ...] if extra else pa.Array
    run.__annotations__ = {"batches": Iterator[kinds], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def annotated(df: DataFrame, result: Column) -> DataFrame:
    """`row` with all columns of df and `out`: no name of df can clash with what comes after."""
    return df.select(F.struct("*").alias("row"), result.alias("out"))


def share(doc_id: str, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.  Where it is unset,
    as in local tests, a temporary folder is used."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives executors.
    `options` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot when it holds more than one row in so many; so no more keys can be hot.
HOT_ONE_IN = 500


def join_hot(
    rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame, how: str = "inner"
) -> DataFrame:
    """Join rows with `keyed` (one row per key) although some keys hold most rows.

    `counts` has (key, n), the rows of each key.  At most HOT_ONE_IN keys hold over one in
    HOT_ONE_IN of all rows: those of `keyed` are broadcast, the rest is a plain shuffled join.
    `how`: inner or left.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counts.where(F.col("n") > max(1000, total // HOT_ONE_IN)).select(key)
    found = hot.collect()  # HOT_ONE_IN keys at most
    if not found:
        return rows.join(keyed, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema))
    cold = rows.join(hot, key, "left_anti").join(keyed.join(hot, key, "left_anti"), key, how)
    warm = rows.join(hot, key, "left_semi").join(
        F.broadcast(keyed.join(hot, key, "left_semi")), key, how
    )
    return cold.unionByName(warm)
