"""Near-duplicate documents: consistent weighted sampling, bands, weighted Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, slices, stored, text_udf, words_of
from tidemark.llm.components import components

#: Document frequencies are counted in so many counters of hashed shingles: 1 MB for any corpus.
COUNTERS = 1 << 18
#: Samples of a text: BANDS times ROWS.  Texts alike by 0.8 share a band but once in 1,500 pairs.
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: Samples that must agree before a pair's texts are compared: four in seven.  At a similarity of
#: 0.8 fewer agree once in 30,000 pairs.
AGREE = SAMPLES * 4 // 7
#: Rows of the table of random variates, looked up by shingle hash.
VARIATES = 1 << 14
#: Features sampled at once; texts of a bucket compared at once; texts and bytes verified at once.
CHUNK, BLOCK, PAIRS, PAIR_BYTES = 4096, 256, 400, 6_000_000

_MIX_INT = 0x9E3779B97F4A7C15
_MIX = np.uint64(_MIX_INT)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (owner, hash, times), by owner and hash.  A text of fewer
    words than `size`, but not none, is one shingle."""
    words = words_of(texts)
    hashed = words.hashes()[words.codes] if len(words.codes) else np.empty(0, np.uint64)
    counts = np.diff(words.bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashed)) - words.bounds[:-1][owner]
    width = np.minimum(counts, size)[owner]
    total = np.zeros(len(hashed), np.uint64)
    factor = _MIX_INT
    for k in range(size):
        shifted = np.zeros(len(hashed), np.uint64)
        shifted[: max(0, len(hashed) - k)] = hashed[k:]
        total += np.where(k < width, shifted * np.uint64(factor), np.uint64(0))
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(29)
    whole = at + width <= counts[owner]
    owner, total = owner[whole], total[whole]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    return owner[first], total[first], np.diff(np.append(first, len(total)))


class Weights:
    """TF-IDF weights: times x (1 + ln((n + 1) / (df + 1)) / ln(n + 1)), between once and twice
    the times.  df is the count of the shingle's counter, so rare shingles share one."""

    def __init__(self, frequencies: np.ndarray, n_docs: int):
        part = np.minimum((frequencies + 1.0) / (n_docs + 1.0), 1.0)
        self.idf = 1.0 - np.log(part) / np.log(n_docs + 2.0)
        self.log_idf = np.log(self.idf)

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times * self.idf[(hashes >> np.uint64(20)) & np.uint64(COUNTERS - 1)]

    def log_of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.log(times) + self.log_idf[(hashes >> np.uint64(20)) & np.uint64(COUNTERS - 1)]


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010): for sample k and a shingle of weight S,
    r and c are Gamma(2, 1), b uniform; t = floor(ln S / r + b), ln y = r (t - b),
    ln a = ln c - ln y - r; the shingle with the least a, with its t, is the sample."""

    def __init__(self, weights: Weights, seed: int = 20):
        rng = np.random.default_rng(seed)
        shape = (VARIATES, SAMPLES)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32) + np.float32(1e-6)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.b = rng.random(shape).astype(np.float32)
        self.weights = weights

    def sample(self, owner: np.ndarray, hashes: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """The samples of n texts as 32-bit integers; of texts without shingles, zeros."""
        best = np.full((n, SAMPLES), np.inf, np.float32)
        out = np.zeros((n, SAMPLES), np.uint32)
        log_s = self.weights.log_of(hashes, times).astype(np.float32)
        row = (hashes & np.uint64(VARIATES - 1)).astype(np.int64)
        for begin in range(0, len(hashes), CHUNK):
            part = slice(begin, begin + CHUNK)
            r, b = self.r[row[part]], self.b[row[part]]
            t = np.floor(log_s[part, None] / r + b)
            log_a = self.log_c[row[part]] - r * (t - b) - r
            here = owner[part]
            start = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            doc = here[start]
            least = np.minimum.reduceat(log_a, start, axis=0)
            index = np.repeat(np.arange(len(doc)), np.diff(np.append(start, len(here))))
            # of equal shingles in order of hash the first wins, here and between chunks
            f, k = np.nonzero(log_a == least[index])
            f, k = f[::-1], k[::-1]
            first = np.empty((len(doc), SAMPLES), np.int64)
            first[index[f], k] = f
            better = least < best[doc]
            best[doc] = np.where(better, least, best[doc])
            chosen = t[first, np.arange(SAMPLES)].astype(np.int64).astype(np.uint64)
            mixed = (hashes[part][first] + chosen * _MIX) * np.uint64(0xD6E8FEB86659FD93)
            out[doc] = np.where(better, (mixed >> np.uint64(32)).astype(np.uint32), out[doc])
        return out


def frequencies(docs: DataFrame, text: str, size: int) -> Weights:
    """Weights from all documents: counts per task, then summed over the cluster."""

    def count(batches):
        total, n = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for piece in slices(batch.column(0)):
                owner, hashes, _ = shingles(piece, size)
                at = ((hashes >> np.uint64(20)) & np.uint64(COUNTERS - 1)).astype(np.int64)
                total += np.bincount(at, minlength=COUNTERS)
                n += len(np.unique(owner))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"counter": np.append(some, -1), "n": np.append(total[some], n)}
        )

    counted = (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(count, "counter bigint, n bigint")
        .groupBy("counter")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counter, n = (counted.column(c).to_numpy() for c in ("counter", "n"))
    table = np.zeros(COUNTERS, np.int64)
    table[counter[counter >= 0]] = n[counter >= 0]
    return Weights(table, int(n[counter < 0].sum()))


def sketched(docs: DataFrame, doc_id: str, text: str, size: int, weights) -> DataFrame:
    """(doc_id, version, weight, samples): version is null for texts without a word."""

    def work():
        sampler = Sampler(weights.value)

        def step(texts):
            n = len(texts)
            owner, hashes, times = shingles(texts, size)
            out = sampler.sample(owner, hashes, times, n).view(np.int32)
            total = np.bincount(owner, sampler.weights.of(hashes, times), minlength=n)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * SAMPLES), pa.array(out.ravel())
            )
            return pa.StructArray.from_arrays([pa.array(total), lists], names=["weight", "samples"])

        return step

    made = text_udf(work, "struct<weight:double,samples:array<int>>")(F.col("text"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", F.md5("text").alias("version"), made.alias("made"))
    worded = F.col("made.weight") > 0
    return rows.select(
        "doc_id",
        F.when(worded, F.col("version")).alias("version"),
        F.when(worded, F.col("made.weight")).alias("weight"),
        F.when(worded, F.col("made.samples")).alias("samples"),
    )


def _features(texts: pa.Array, size: int, weights: Weights):
    """(hashes, weights, total weight) of each text, in order."""
    for piece in slices(texts):
        owner, hashes, times = shingles(piece, size)
        w = weights.of(hashes, times)
        cut = np.searchsorted(owner, np.arange(len(piece) + 1))
        for i in range(len(piece)):
            part = slice(cut[i], cut[i + 1])
            yield hashes[part], w[part], w[part].sum()


def _alike(one, other, least: float) -> bool:
    """Whether the weighted Jaccard similarity of two texts' features is at least `least`."""
    hashes, w, total = one
    others, v, other_total = other
    spot = np.minimum(np.searchsorted(others, hashes), len(others) - 1)
    same = others[spot] == hashes
    shared = np.minimum(w[same], v[spot[same]]).sum()
    return shared >= least * (total + other_total - shared) * (1 - 1e-12)


def similarities(left: pa.Table, right: pa.Table, size: int, weights: Weights, least: float):
    """Pairs of `left` (head, version, text) that are alike the head's text in `right`."""
    unique = {h: i for i, h in enumerate(right.column("head").to_pylist())}
    texts = right.column("body").combine_chunks().take(pa.array(list(unique.values()), pa.int64()))
    heads = dict(zip(unique, _features(texts, size, weights)))
    owners, versions = left.column("head").to_pylist(), left.column("version").to_pylist()
    found = _features(left.column("text").combine_chunks(), size, weights)
    links = [
        (h, v) for h, v, features in zip(owners, versions, found) if _alike(features, heads[h], least)
    ]
    return pa.table(
        {"a": pa.array([h for h, _ in links], pa.string()),
         "b": pa.array([v for _, v in links], pa.string())}
    )


def verified(pairs: DataFrame, bodies: DataFrame, size: int, weights, least: float) -> DataFrame:
    """Edges (a, b) for those of the distinct pairs (head, version) that are alike enough.

    A head with many pairs is dealt over many tasks with a copy of its text for each.
    """
    pairs = stored(pairs.select("head", "version").distinct(), "pairs")
    counts = stored(pairs.groupBy("head").agg(F.count("*").alias("n")), "heads")
    deals = counts.select("head", F.ceil(F.col("n") / PAIRS).cast("int").alias("deals"))
    total = pairs.join(bodies, "version").agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")
    ).first()
    groups = max(1, -(-total["n"] // PAIRS), -(-total["size"] // PAIR_BYTES))
    group = F.pmod(F.xxhash64("head", "deal"), F.lit(groups)).alias("part")
    left = (
        join_hot(pairs, deals, "head", counts)
        .withColumn("deal", F.pmod(F.xxhash64("version"), F.col("deals")))
        .join(bodies, "version")
        .select("head", "version", "text", group)
    )
    right = (
        deals.select("head", F.explode(F.expr("sequence(0L, deals - 1L)")).alias("deal"))
        .join(bodies.withColumnRenamed("version", "head"), "head")
        .select("head", F.col("text").alias("body"), group)
    )

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        return similarities(some, others, size, weights.value, least)

    return (
        left.groupBy("part")
        .cogroup(right.groupBy("part"))
        .applyInArrow(meet, "a string, b string")
    )


def rivals(members: DataFrame, size: int, weights, least: float) -> DataFrame:
    """Edges (a, b) between texts of one bucket but different components.

    A bucket is dealt into blocks and each pair of blocks meets in one task, with the texts.  There
    a pair is compared if its samples and total weights allow it and it is not yet connected by
    pairs before it, so a task returns a tree's worth of links and never the pairs.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("version"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )
    size_of = members.agg(
        F.coalesce(F.sum(blocks), F.lit(0)).alias("n"),
        F.coalesce(F.sum(blocks * F.octet_length("text")), F.lit(0)).alias("size"),
    ).first()
    groups = max(1, -(-size_of["n"] // (4 * BLOCK)), -(-size_of["size"] // PAIR_BYTES))
    part = F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups)).alias("part")

    def compare(table: pa.Table) -> pa.Table:
        links = _block_links(table, size, weights.value, least)
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.string()),
             "b": pa.array([y for _, y in links], pa.string())}
        )

    wanted = ["key", "low", "high", "own", "version", "label", "weight", "samples", "text"]
    return dealt.select(*wanted, part).groupBy("part").applyInArrow(compare, "a string, b string")


def _block_links(table: pa.Table, size: int, weights: Weights, least: float):
    lists = table.column("samples").combine_chunks()
    samples = lists.flatten().to_numpy().reshape(-1, SAMPLES)
    key, low, high, own, weight = (
        table.column(c).to_numpy() for c in ("key", "low", "high", "own", "weight")
    )
    version = table.column("version").to_pylist()
    label = table.column("label").to_pylist()
    made = {}
    names = {v: i for i, v in enumerate(version)}
    texts = table.column("text").combine_chunks().take(pa.array(list(names.values()), pa.int64()))
    for (name, _), features in zip(names.items(), _features(texts, size, weights)):
        made[name] = features
    order = np.lexsort((high, low, key))
    triple = np.stack([key[order], low[order], high[order]])
    cuts = np.flatnonzero(
        np.concatenate([[True], (triple[:, 1:] != triple[:, :-1]).any(axis=0), [True]])
    )
    links = []
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        mine = rows[own[rows] == low[rows[0]]]
        theirs = rows[own[rows] == high[rows[0]]]
        one_block = low[rows[0]] == high[rows[0]]
        for place, i in enumerate(mine):
            others = theirs[place + 1 :] if one_block else theirs
            heavy, light = (f(weight[others], weight[i]) for f in (np.maximum, np.minimum))
            can = others[light >= least * heavy * (1 - 1e-9)]
            can = can[(samples[can] == samples[i]).sum(axis=1) >= AGREE]
            for j in can:
                mine_root, other_root = find(label[i]), find(label[j])
                if mine_root != other_root and _alike(made[version[i]], made[version[j]], least):
                    root[mine_root] = other_root
                    links.append((version[i], version[j]))
    return links


def classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    least: float = 0.8,
) -> DataFrame:
    """(doc_id, class_id, copies): for each document the smallest id of the documents it is
    connected with by links of a weighted Jaccard similarity of at least `least` over TF-IDF
    weighted shingles of `size` words, and the number of documents with just its text.

    Equal texts are one node.  Nodes with equal samples in a band meet in a bucket; each is
    compared with the bucket's head first, which links a group of copies with as many
    comparisons as texts.  What is still in different components of a bucket is then compared
    with all of the bucket, but for pairs that samples or total weights rule out.  Links are
    always verified on whole texts.

    A text of fewer than `size` words is one shingle; null and wordless texts are alone; a null id
    is kept and counts as larger than any; equal rows are answered each, and rows of one id with
    different texts are connected through it only if their texts are alike.
    """
    spark: SparkSession = docs.sparkSession
    weights = spark.sparkContext.broadcast(frequencies(docs, text, size))
    rows = stored(sketched(docs, doc_id, text, size, weights), "sketches")
    nodes = stored(
        rows.where(F.col("version").isNotNull())
        .groupBy("version")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("weight").alias("weight"),
            F.first("samples").alias("samples"),
        ),
        "nodes",
    )
    keys = F.array(
        *[F.xxhash64(F.lit(b), F.slice("samples", b * ROWS + 1, ROWS)) for b in range(BANDS)]
    )
    banded = nodes.select("version", F.explode(keys).alias("key"))
    buckets = stored(
        banded.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("version").alias("head"))
        .where(F.col("n") > 1),
        "buckets",
    )
    members = stored(join_hot(banded, buckets, "key", buckets.select("key", "n")), "members")
    needed = members.select(F.col("version").alias("_version")).distinct()
    needed = nodes.select(F.col("version").alias("_version"), F.col("first_id").alias("_id")).join(
        needed, "_version"
    )
    # null-safe: a text may occur in rows without an id only
    own = (F.col("version") == F.col("_version")) & F.col("first_id").eqNullSafe(F.col("_id"))
    bodies = stored(
        docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("first_id"))
        .withColumn("version", F.md5("text"))
        .join(needed, own)
        .select("version", "text")
        .dropDuplicates(["version"]),
        "bodies",
    )
    stars = stored(
        members.where(F.col("version") != F.col("head")).select("head", "version").distinct(),
        "stars",
    )
    counts = stars.groupBy("head").agg(F.count("*").alias("n"))
    sketch = nodes.select("version", "weight", "samples")
    heads = sketch.toDF("head", "head_weight", "head_samples")
    close = join_hot(stars.join(sketch, "version"), heads, "head", counts).where(
        _agreeing("samples", "head_samples") >= AGREE
    )
    close = close.where(_as_heavy("weight", "head_weight", least))
    edges = stored(verified(close, bodies, size, weights, least), "links")
    labels = components(edges).withColumnRenamed("node", "version")
    known = stored(
        members.select("key", "n", "version").join(labels, "version", "left").select(
            "key", "n", "version", F.coalesce("label", "version").alias("label")
        ),
        "labelled",
    )
    mixed = (
        known.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
        .where(F.col("a") != F.col("b"))
        .select("key", "n")
    )
    mixed = stored(mixed, "mixed")
    rest = join_hot(known.drop("n"), mixed, "key", mixed).join(sketch, "version")
    rest = stored(rest.join(bodies, "version"), "rest")
    edges = edges.unionByName(stored(rivals(rest, size, weights, least), "links"))
    labels = components(edges).withColumnRenamed("node", "version")
    named = nodes.select("version", "first_id", "copies").join(labels, "version", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "version")), "named")
    groups = named.groupBy("label").agg(
        F.count("*").alias("n"), F.min("first_id").alias("class_id")
    )
    groups = stored(groups, "groups")
    by_version = join_hot(named, groups.drop("n"), "label", groups.select("label", "n"))
    sizes = named.select("version", F.col("copies").alias("n"))
    answered = join_hot(
        rows.select("doc_id", "version"),
        by_version.select("version", "class_id", "copies"),
        "version",
        sizes,
        "left",
    )
    return answered.select(
        "doc_id",
        F.when(F.col("version").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
    )


def _agreeing(a: str, b: str):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x
    )


def _as_heavy(a: str, b: str, least: float):
    return F.least(a, b) >= F.greatest(a, b) * (least * (1 - 1e-9))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each class, the one with the smallest id; columns unchanged.  Of equal ids
    in a class one row stays; null and wordless texts stay, as do documents without an id."""
    found = classes(docs, doc_id=doc_id, **options)
    text = options.get("text", "text")
    keep = found.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("_id"), F.md5(F.col(text)).alias("_text")
    )
    kept = keyed.join(keep, F.col("_id") == F.col("doc_id"), "left_semi")
    # rows of one id and text are one document; those of one id with different texts both stay
    first = kept.dropDuplicates(["_id", "_text"]).select("row.*")
    return first.unionByName(keyed.where(F.col("_id").isNull()).select("row.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs.select("doc_id", "text"))
