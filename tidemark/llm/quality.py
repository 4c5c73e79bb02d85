"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotated, bytes_of, share, text_udf, words_of

#: Counters of hashed words, bins of each statistic, and the statistics.
WORDS, BINS = 4096, 12
STATISTICS = (
    "upper digit punctuation space other symbol repeat distinct common word_size line_size n_words"
    " n_chars"
).split()
WIDTH = WORDS + BINS * len(STATISTICS)

_CODE = np.arange(256)
_CLASSES = {
    "upper": (_CODE >= 65) & (_CODE <= 90),
    "digit": (_CODE >= 48) & (_CODE <= 57),
    "punctuation": np.isin(_CODE, list(b".,;:!?'\"()-")),
    "space": np.isin(_CODE, list(b" \t\n\r")),
    "other": _CODE >= 128,
    "symbol": np.isin(_CODE, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
}
_LINE = _CODE == 10


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def features(texts: pa.Array, n_chars: pa.Array | None = None):
    """Sparse rows: (bounds, index, value).  Word values are log counts at length one; each
    statistic, shares on a square-root scale and sizes on a log scale, sets one of its bins."""
    flat, at = bytes_of(texts)
    size = np.maximum(np.diff(at), 1)
    stats = {k: np.sqrt(_per_text(flag[flat], at) / size) for k, flag in _CLASSES.items()}
    words = words_of(texts)
    n = len(texts)
    count = np.diff(words.bounds)
    doc = np.repeat(np.arange(n), count)
    bucket = (words.hashes() % np.uint64(WORDS)).astype(np.int64)
    pairs, times = np.unique(doc * WORDS + bucket[words.codes], return_counts=True)
    owner, index = pairs // WORDS, pairs % WORDS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = value / np.maximum(norm, 1e-12)[owner]
    some = np.maximum(count, 1)
    twice = np.zeros(len(words.codes))
    twice[1:] = (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])
    most = np.zeros(n)
    np.maximum.at(most, owner, times)
    stats["repeat"] = np.bincount(doc, twice, minlength=n) / some
    stats["distinct"] = np.bincount(owner, minlength=n) / np.minimum(some, WORDS)
    stats["common"] = np.sqrt(most / some)
    stats["word_size"] = np.minimum(size / some, 24) / 24
    stats["line_size"] = np.log1p(size / (1 + _per_text(_LINE[flat], at))) / 16
    stats["n_words"] = np.log1p(count) / 16
    given = np.full(n, np.nan)
    if n_chars is not None:
        given = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    stats["n_chars"] = np.log1p(np.maximum(np.nan_to_num(given, nan=0.0), 0.0)) / 24
    bins = np.stack(
        [np.clip((stats[k] * BINS).astype(int), 0, BINS - 1) for k in STATISTICS], axis=1
    )
    bins += WORDS + BINS * np.arange(len(STATISTICS))
    # the words and the bins of each text side by side
    per = np.bincount(owner, minlength=n) + len(STATISTICS)
    bounds = np.concatenate([[0], np.cumsum(per)])
    all_index = np.empty(bounds[-1], np.int32)
    all_value = np.full(bounds[-1], 0.5, np.float32)
    spot = bounds[:-1, None] + np.arange(len(STATISTICS))
    all_index[spot] = bins
    rest = np.ones(bounds[-1], bool)
    rest[spot] = False
    all_index[rest], all_value[rest] = index, value
    return bounds, all_index, all_value


class Machine:
    """Weights of a factorisation machine: bias, one weight and one short vector per feature."""

    def __init__(self, rank: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.weight = np.zeros(WIDTH, np.float32)
        self.factor = (rng.normal(size=(WIDTH, rank)) * 0.05).astype(np.float32)

    def score(self, bounds: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of label 1.  The pairwise part is half of (the square of the sum less the
        sum of squares), so the time is linear in the features of a text."""
        if len(bounds) == 1:
            return np.zeros(0)
        start = bounds[:-1]
        scaled = self.factor[index] * value[:, None]
        total = np.add.reduceat(scaled, start, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), start)
        linear = np.add.reduceat(self.weight[index] * value, start)
        z = self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def learn(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
              epochs: int = 30, batch: int = 64, rate: float = 0.02, decay: float = 1e-4):
        """Adam on the logistic loss over small dense batches."""
        rng = np.random.default_rng(11)
        mean = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
        self.bias = float(np.log(mean / (1 - mean)))
        params = [self.weight, self.factor]
        first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for begin in range(0, len(rows), batch):
                chosen = order[begin : begin + batch]
                x = np.zeros((len(chosen), WIDTH), np.float32)
                for i, r in enumerate(chosen):
                    x[i, rows[r][0]] = rows[r][1]
                total = x @ self.factor
                squares = (x * x) @ (self.factor * self.factor).sum(axis=1)
                z = self.bias + x @ self.weight + 0.5 * ((total * total).sum(axis=1) - squares)
                gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[chosen]) / len(chosen)
                gap = gap.astype(np.float32)
                self.bias -= rate * float(gap.sum())
                one = x.T @ gap
                two = x.T @ (gap[:, None] * total) - ((x * x).T @ gap)[:, None] * self.factor
                step += 1
                for k, g in enumerate((one, two)):
                    g += decay * params[k]
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    fair = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    params[k] -= fair * first[k] / (np.sqrt(second[k]) + 1e-8)
        return self


def _given(docs: DataFrame):
    return F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = 4000, epochs: int = 30
) -> Machine:
    """A machine from a bounded sample: the `rows` labelled ids outside fold 0 with the smallest
    hash.  Only text and n_chars are looked at.  Null ids, labels and texts teach nothing; an id
    with several labels has the largest."""
    marked = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("quality").alias("quality"))
        .where(share("id", folds) != 0)
    )
    picked = marked.orderBy(F.xxhash64("id"), "id").limit(rows)

    def work():
        def step(texts, sizes):
            bounds, index, value = features(texts, sizes)
            cut = list(zip(bounds[:-1], bounds[1:]))
            return pa.StructArray.from_arrays(
                [pa.array([index[a:b].tobytes() for a, b in cut], pa.binary()),
                 pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())],
                names=["index", "value"],
            )

        return step

    # the sample holds at most `rows` ids; of repeated ids one text is taken
    sample = (
        docs.select(F.col("doc_id").alias("id"), "text", _given(docs).alias("given"))
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked), "id")
        .groupBy("id")
        .agg(F.min(F.struct("text", "given", "quality")).alias("one"))
    )
    made = text_udf(work, "struct<index:binary,value:binary>", 1)("one.text", "one.given")
    taken = sample.select("id", "one.quality", made.alias("x")).collect()
    taken.sort(key=lambda r: str(r["id"]))
    data = [
        (np.frombuffer(r["x"]["index"], np.int32), np.frombuffer(r["x"]["value"], np.float32))
        for r in taken
    ]
    return Machine().learn(data, np.array([r["quality"] for r in taken], float), epochs)


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(row, out): each document with its probability of label 1.  A null text scores as an empty
    one; a missing or null n_chars counts as 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = sent.value
        return lambda texts, sizes: pa.array(
            known.score(*features(texts, sizes)).astype(float), pa.float64()
        )

    return annotated(docs, text_udf(work, "double", 1)(F.col("text"), _given(docs)))


def drop_poor(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents with a score of at least `least`; columns unchanged."""
    return score(docs, train(docs, labels)).where(F.col("out") >= least).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text", "n_chars"), train(docs, labels))
    return scored.select(
        "row.doc_id",
        (share("row.doc_id", 5) == 0).alias("held_out"),
        F.col("out").alias("score"),
        (F.col("out") >= 0.3).cast("int").alias("predicted"),
    )
