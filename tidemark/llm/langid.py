"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM, annotated, bytes_of, share, text_udf

#: n-grams are hashed into so many counters.
BUCKETS = 4096
#: Texts that are made vectors together.
GROUP = 256
#: Beyond this distance a text is always rejected.
FARTHEST = 0.9

RESULT = "struct<lang:string,score:double,rejected:boolean>"

#: Letters only: digits part words as punctuation does.
_LETTERS = np.where((ALNUM >= 48) & (ALNUM <= 57), 0, ALNUM).astype(np.uint32)


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams of lower-cased texts; runs without letters do not count."""
    flat, at = bytes_of(texts)
    letters = _LETTERS[flat]
    if len(letters) < 3:
        return np.zeros((len(texts), BUCKETS), np.float32)
    gram = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(32 - 12)).astype(np.int64)
    # a trigram lies in the text it begins in, and holds two letters at least
    left = np.repeat(at[1:], np.diff(at))[: len(gram)] - np.arange(len(gram))
    use = (left >= 3) & (((letters[:-2] != 0) & (letters[1:-1] != 0)) | (letters[2:] != 0))
    bucket += np.repeat(np.arange(len(texts)) * BUCKETS, np.diff(at))[: len(gram)]
    counts = np.bincount(bucket[use], minlength=len(texts) * BUCKETS)
    return counts.astype(np.float32).reshape(len(texts), BUCKETS)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero row stays zero."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(size, 1e-12)


class Centroids:
    """Trained by `fit`; small enough to be sent with a task."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, owner: np.ndarray,
                 radius: np.ndarray):
        self.langs, self.idf, self.centres = langs, idf, centres
        self.owner, self.radius = owner, radius

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = unit(np.log1p(counts) * self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each next start is the row farthest from those before."""
    start = [0]
    near = x @ x[0]
    while len(start) < min(k, len(x)):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    centres = x[start]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[nearest == j].sum(axis=0) for j in range(len(centres))])
        empty = ~(nearest[None, :] == np.arange(len(centres))[:, None]).any(axis=1)
        sums[empty] = centres[empty]
        centres = unit(sums)
    return centres


def fit(rows: list[tuple[str, np.ndarray]], per_lang: int = 4, slack: float = 1.5) -> Centroids:
    """Centroids from (language, trigram counts).  A text is rejected beyond `slack` times the
    largest training distance of its centroid, or beyond FARTHEST."""
    rows = sorted(rows, key=lambda r: r[0])
    langs = sorted({lang for lang, _ in rows})
    if not rows:
        none = np.zeros((0, BUCKETS), np.float32)
        return Centroids([], np.ones(BUCKETS, np.float32), none, np.zeros(0, int), np.zeros(0))
    counts = np.stack([c for _, c in rows]).astype(np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(np.log1p(counts) * idf)
    label = np.array([langs.index(lang) for lang, _ in rows])
    groups = [clusters(x[label == j], per_lang) for j in range(len(langs))]
    centres = np.concatenate(groups).astype(np.float32)
    owner = np.repeat(np.arange(len(langs)), [len(g) for g in groups])
    model = Centroids(langs, idf, centres, owner, np.zeros(len(owner)))
    best, cosine = model.nearest(counts)
    far = np.zeros(len(owner))
    np.maximum.at(far, best, 1.0 - cosine)
    model.radius = np.where(far > 0, np.minimum(far * slack, FARTHEST), FARTHEST)
    return model


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 5,
    rows_per_lang: int = 300,
    per_lang: int = 4,
) -> Centroids:
    """Centroids from a bounded sample of the rows outside fold 0: those `rows_per_lang` rows of
    each language with the smallest hash of their id.  Null texts and languages teach nothing."""
    known = docs.select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (share("id", folds) != 0))
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = (
        known.select("id", "lang")
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= rows_per_lang)
        .select("id", "lang")
        .distinct()
    )

    def work():
        def step(texts):
            parts = [texts.slice(i, GROUP) for i in range(0, len(texts), GROUP)]
            return pa.array(
                [row.tobytes() for p in parts for row in ngram_counts(p)], pa.binary()
            )

        return step

    # the sample is at most rows_per_lang rows a language
    sample = known.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(
        F.min("text").alias("text")
    )
    rows = sample.select("id", "lang", text_udf(work, "binary")("text").alias("counts"))
    taken = [(r["id"], r["lang"], r["counts"]) for r in rows.collect()]
    taken.sort(key=lambda r: (str(r[0]), r[1]))
    return fit([(la, np.frombuffer(c, np.float32)) for _, la, c in taken], per_lang)


def identify(
    docs: DataFrame, model: Centroids, text: str = "text", reject: bool = True
) -> DataFrame:
    """(row, out): each document with its language, the cosine of the nearest centroid and whether
    it lies too far from it.  Rejected texts are `und` if `reject` is set.  A null text, one
    without a letter, or any text of a model without languages is `und` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        known = sent.value
        names = np.array(known.langs, dtype=object)

        def step(texts):
            langs, scores, far = [], [], []
            for i in range(0, len(texts), GROUP):
                part = texts.slice(i, GROUP)
                if not len(names):
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    far += [True] * len(part)
                    continue
                best, cosine = known.nearest(ngram_counts(part))
                out = 1.0 - cosine > known.radius[best]
                lang = names[known.owner[best]]
                langs += list(np.where(out & reject, "und", lang))
                scores += cosine.astype(float).tolist()
                far += out.tolist()
            return pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(far, pa.bool_())], names=["lang", "score", "rejected"],
            )

        return step

    found = text_udf(work, RESULT)(F.col(text))
    none = F.struct(
        F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")
    )
    both = docs.select(
        F.struct("*").alias("row"),
        found.alias("found"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("worded"),
    )
    return both.select("row", F.when(F.col("worded"), F.col("found")).otherwise(none).alias("out"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs), reject=False)
    return found.select(
        "row.doc_id",
        (share("row.doc_id", 5) == 0).alias("held_out"),
        F.col("out.lang").alias("lang_pred"),
        F.col("out.score").alias("score"),
        F.col("out.rejected").alias("rejected"),
    )
