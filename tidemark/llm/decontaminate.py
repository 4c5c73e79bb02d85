"""Benchmark decontamination with suffix arrays over shards of the training words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotated, text_udf, words_of

#: Bytes of distinct benchmark texts in one broadcast; a larger benchmark takes more passes.
BLOCK_BYTES = 8_000_000

FOUND = (
    "struct<n_words:bigint,n_hit:bigint,item_ids:array<string>,"
    "matches:array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>>"
)
_MATCH = pa.struct(
    [
        ("item_id", pa.string()),
        ("item_word", pa.int32()),
        ("doc_word", pa.int32()),
        ("n_words", pa.int32()),
    ]
)


class TestBlock:
    """The suffixes of a block of test items, as numbers of its own vocabulary."""

    def __init__(self, items: list[tuple[list[str], str]], window: int):
        self.names = [ids for ids, _ in items]
        words = words_of(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = words.vocabulary
        sizes = np.diff(words.bounds)
        width = np.minimum(sizes, window)
        item = np.repeat(np.arange(len(items)), sizes)
        at = np.arange(len(words.codes)) - words.bounds[:-1][item]
        # a suffix counts when a whole window begins at it
        use = at + width[item] <= sizes[item]
        self.codes, self.begin = words.codes, np.flatnonzero(use)
        self.item, self.at, self.width = item[use], at[use], width[item][use]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `codes` in the order of their suffixes, compared to `depth` words.

    The first words are packed into one integer and sorted; positions that still tie are then
    ordered by prefix doubling.
    """
    n = len(codes)
    if not n:
        return np.empty(0, np.int64)
    low = codes - codes.min()
    bits = max(1, int(low.max() + 1).bit_length())
    take = min(max(1, 63 // bits), max(1, depth))
    padded = np.concatenate([low + 1, np.zeros(take, np.int64)])
    bits = max(1, int(padded.max()).bit_length())
    take = min(max(1, 63 // bits), take)
    key = np.zeros(n, np.int64)
    for k in range(take):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    reach = take
    while reach < depth:
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            break
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.repeat(first, size) + 1
        rank[n] = 0
        slots = np.flatnonzero(tied)
        where = order[slots]
        pair = rank[where] * (n + 2) + rank[np.minimum(where + reach, n)]
        sub = np.argsort(pair)
        order[slots] = where[sub]
        pair = pair[sub]
        fresh[slots] = np.concatenate([[True], pair[1:] != pair[:-1]])
        reach *= 2
    return order


def search(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, begin: np.ndarray,
           width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of `order` whose suffixes begin with `wanted[b : b + w]`, for every (b, w)."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    ended = np.append(codes, np.iinfo(np.int64).min)
    for depth in range(int(width.max()) if len(width) else 0):
        live = np.flatnonzero((low < high) & (depth < width))
        if not len(live):
            break
        target = wanted[begin[live] + depth]
        ends = []
        for past in (False, True):
            lo, hi = low[live].copy(), high[live].copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    break
                mid = (lo + hi) >> 1
                here = ended[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(codes))]
                right = open_ & ((here <= target) if past else (here < target))
                lo = np.where(right, mid + 1, lo)
                hi = np.where(open_ & ~right, mid, hi)
            ends.append(lo)
        low[live], high[live] = ends
    return low, high


def match_shard(texts: pa.Array, block: TestBlock) -> pa.Array:
    """What of the block occurs in each text of a shard."""
    words = words_of(texts)
    docs = len(texts)
    sizes = np.diff(words.bounds)
    # a code of its own ends each text, so no match goes on into the next one
    codes = np.empty(len(words.codes) + docs, np.int64)
    gap = words.bounds[1:] + np.arange(docs)
    keep = np.ones(len(codes), bool)
    keep[gap] = False
    codes[keep], codes[gap] = words.codes, -1 - np.arange(docs)
    begins = words.bounds[:-1] + np.arange(docs)
    known = pc.index_in(block.vocabulary, value_set=words.vocabulary)
    known = known.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
    wanted = known[block.codes] if len(block.codes) else np.empty(0, np.int64)
    order = suffix_array(codes, int(block.width.max()) if len(block.width) else 1)
    low, high = search(codes, order, wanted, block.begin, block.width)
    times = high - low
    suffix = np.repeat(np.arange(len(times)), times)
    spot = order[np.repeat(low, times) + np.arange(len(suffix)) - np.repeat(
        np.cumsum(times) - times, times)]
    width = block.width[suffix]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, spot, 1)
    np.add.at(cover, spot + width, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit = hit[gap] - hit[begins]
    doc = np.searchsorted(gap, spot)
    # windows that follow each other in item and text are one longest match
    item, at, place = block.item[suffix], block.at[suffix], spot - begins[doc]
    by = np.lexsort((place, place - at, item, doc))
    doc, item, at, place, width = (x[by] for x in (doc, item, at, place, width))
    same = np.zeros(len(by), bool)
    same[1:] = (
        (doc[1:] == doc[:-1])
        & (item[1:] == item[:-1])
        & (place[1:] - at[1:] == place[:-1] - at[:-1])
        & (place[1:] == place[:-1] + 1)
    )
    head = np.flatnonzero(~same)
    runs = np.diff(np.append(head, len(by)))
    doc, item, at, place, length = doc[head], item[head], at[head], place[head], (
        width[head] + runs - 1)
    counts = np.bincount(doc, minlength=docs)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    ids: list[list[str]] = [[] for _ in range(docs)]
    for d in np.flatnonzero(counts):
        seen = np.unique(item[offsets[d] : offsets[d + 1]])
        ids[d] = sorted({x for i in seen for x in block.names[i]})
    matches = pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays(
            [
                pa.array([block.names[i][0] for i in item], pa.string()),
                pa.array(at.astype(np.int32)),
                pa.array(place.astype(np.int32)),
                pa.array(length.astype(np.int32)),
            ],
            fields=list(_MATCH),
        ),
    )
    return pa.StructArray.from_arrays(
        [pa.array(sizes.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
         pa.array(ids, pa.list_(pa.string())), matches],
        names=["n_words", "n_hit", "item_ids", "matches"],
    )


def item_blocks(
    items: DataFrame, item_id: str, text: str, limit: int
) -> Iterator[list[tuple[list[str], str]]]:
    """Distinct item texts with their ids, in blocks of about `limit` bytes, one at a time.  A text
    of very many ids goes out in several blocks."""
    known = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    pairs = known.select(F.col(text).alias("text"), F.col(item_id).cast("string").alias("id"))
    block: list[tuple[list[str], str]] = []
    size = 0
    for row in pairs.distinct().orderBy("text", "id").toLocalIterator():
        if not block or block[-1][1] != row["text"]:
            block.append(([], row["text"]))
            size += len(row["text"].encode())
        block[-1][0].append(row["id"])
        size += len(row["id"])
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Benchmark items in documents: (row: the document, found: FOUND).

    Each task lays a suffix array over the words of a shard of its texts and binary-searches every
    suffix of the test items in it.  A run of `window` item words found in a text counts, or the
    whole item if it is shorter; `matches` are the longest verbatim runs with their places in
    item and document, `n_hit` the document words inside any.  Items go out in blocks of bounded
    size; each block is one pass over the texts, without a shuffle.

    Null or wordless texts have no words and no hits; null or wordless items and items
    without id match nothing; equal item texts all match, the first id names the places.
    Repeated documents are each answered; columns of any name are kept in `row`.
    """
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.lit(None).cast(FOUND).alias("found"))
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    ahead = list(islice(blocks, 2)) or [[]]  # a second one tells whether results are to be merged
    several = len(ahead) > 1
    for block in chain(ahead, blocks):
        sent = spark.sparkContext.broadcast(block)

        def work(sent=sent):
            tests = TestBlock(sent.value, window)
            return lambda texts: match_shard(texts, tests)

        now = text_udf(work, FOUND)(F.col("row").getField(text))
        out = out.select("row", "found", now.alias("now"))
        out = out.select("row", _merged(F.col("found"), F.col("now"), several))
    return out


def _merged(old, new, several: bool):
    if not several:
        return new.alias("found")
    both = F.struct(
        new["n_words"].alias("n_words"),
        _covered(F.concat(old["matches"], new["matches"])).alias("n_hit"),
        F.array_sort(F.array_union(old["item_ids"], new["item_ids"])).alias("item_ids"),
        F.concat(old["matches"], new["matches"]).alias("matches"),
    )
    return F.when(old.isNull(), new).otherwise(both).cast(FOUND).alias("found")


def _covered(matches):
    """Words inside any of the matches."""
    spans = F.array_sort(
        F.transform(
            matches,
            lambda m: F.struct(
                m["doc_word"].cast("bigint").alias("a"),
                (m["doc_word"] + m["n_words"]).cast("bigint").alias("b"),
            ),
        )
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda s, m: F.struct(
            (s["n"] + F.greatest(m["b"] - F.greatest(m["a"], s["end"]), F.lit(0))).alias("n"),
            F.greatest(s["end"], m["b"]).alias("end"),
        ),
        lambda s: s["n"],
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents of which no word lies in a benchmark run; columns unchanged."""
    return find_matches(docs, items, **options).where("found.n_hit = 0").select("row.*")


def op1(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every document, with the items that occur in it."""
    found = find_matches(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return found.select(
        "row.doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.item_ids"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def digest(ids: list[str]) -> str:
    """The digest of a list of item ids, as op1 gives it."""
    return sha256(",".join(sorted(ids)).encode()).hexdigest()
