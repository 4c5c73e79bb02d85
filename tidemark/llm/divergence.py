"""Divergence between the sources of a language: each group scatters its terms through a term-major
index into a dense accumulator of its peers, after Gustavson's row-wise sparse product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import bytes_of, slices, stored, words_of

#: Probabilities are whole numbers over this.
UNIT = 1_000_000_000
#: Documents of its language that a term must be in to be kept.
MIN_DOCS = 3
#: Terms reported of each group.
TOP = 200
#: Postings of a shard of the index, about; an accumulator of a shard is added up in one task.
SHARD_POSTINGS = 200_000
#: Bytes of text counted at once: the more, the fewer partial counts are shuffled.
COUNT_BYTES = 16_000_000

_BYTE = np.arange(128, dtype=np.uint8)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
#: Byte table of terms: letters, A-Z in lower case, and everything outside ASCII.
LETTERS = np.concatenate(
    [
        np.where(_UPPER, _BYTE + 32, np.where((_BYTE >= 97) & (_BYTE <= 122), _BYTE, 0)),
        np.arange(128, 256),
    ]
).astype(np.uint8)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, first key first, and where runs of equal keys begin."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _counted(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of the terms of texts, each text in a group."""
    words = words_of(texts, LETTERS)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    order, first = _runs(words.codes, doc)  # one run a (term, document)
    code, of = words.codes[order][first], group[doc[order][first]]
    times = np.diff(np.append(first, len(order)))
    order, first = _runs(of, code)
    count = np.add.reduceat(times[order], first) if len(first) else times
    docs = np.diff(np.append(first, len(order)))
    return of[order][first], words.vocabulary.take(pa.array(code[order][first])), count, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of documents (lang, source, text) without nulls: counts and
    numbers of documents, added up in each slice of a task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held)
            keys = zip(*(table.column(c).to_pylist() for c in ("lang", "source")), strict=True)
            seen: dict[tuple[str, str], int] = {}
            group = np.fromiter((seen.setdefault(k, len(seen)) for k in keys), np.int64, len(table))
            names = list(seen)
            begin, texts = 0, table.column("text").combine_chunks()
            for piece in slices(texts, COUNT_BYTES):
                of, term, n, d = _counted(piece, group[begin : begin + len(piece)])
                begin += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in names], pa.string()).take(pa.array(of)),
                        pa.array([x[1] for x in names], pa.string()).take(pa.array(of)),
                        term.cast(pa.string()),
                        pa.array(n, pa.int64()),
                        pa.array(d, pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "docs"],
                )

        for batch in batches:
            held.append(batch)
            size += len(bytes_of(batch.column("text"))[0])
            if size >= COUNT_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    schema = "lang string, source string, term string, count bigint, docs bigint"
    partial = docs.select("lang", "source", "text").mapInArrow(count, schema)
    return partial.groupBy("lang", "source", "term").agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact: three digits of a thousand at a time."""
    rest, digits = np.asarray(count, np.int64) + 1, np.int64(0)
    total = np.asarray(total, np.int64)
    whole, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // total
        rest = rest % total
    return 1 + whole * UNIT + digits


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def probability_column(count: Column, total: Column) -> Column:
    """`probability` as an expression; total is at most 9e15."""
    rest, digits = (count + 1) % total, F.lit(0).cast("bigint")
    for _ in range(3):
        digits, rest = digits * 1000 + _div(rest * 1000, total), rest * 1000 % total
    return _div(count + 1, total) * UNIT + digits + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _accumulate(shard: pa.Table) -> pa.Table:
    """One shard of the term-major index: (lang, source, item, value) of every two sources that
    share a term, what their shared terms add over their zero baselines."""
    lang = shard.column("lang")[0].as_py()
    source = shard.column("source").combine_chunks().dictionary_encode()
    names = source.dictionary
    group = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    term = shard.column("term").combine_chunks().dictionary_encode().indices
    term = term.to_numpy(zero_copy_only=False).astype(np.int64)
    count = shard.column("count").to_numpy().astype(np.int64)
    total = shard.column("total").to_numpy().astype(np.int64)
    p, zero = probability(count, total), probability(np.zeros_like(count), total)
    # term-major: postings of term t are by_term[at[t] : at[t + 1]]
    by_term = np.argsort(term, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(term))])
    of, p_of, zero_of = group[by_term], p[by_term], zero[by_term]
    by_group = np.argsort(group, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(names)))])
    rows, items, values = [], [], []
    for g in range(len(names)):
        sums = np.zeros(len(names), np.int64)  # the dense accumulator of this group's peers
        met = np.zeros(len(names), bool)
        mine = by_group[ends[g] : ends[g + 1]]
        sizes = at[term[mine] + 1] - at[term[mine]]
        # the group's terms in pieces whose postings are few enough to hold
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(1_000_000, sizes.sum(), 1_000_000))
        for part in np.split(np.arange(len(mine)), np.unique(cuts)):
            if not len(part):
                continue
            n = sizes[part]
            begin = np.repeat(at[term[mine[part]]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            peer = np.arange(n.sum()) + begin
            a, a0 = np.repeat(p[mine[part]], n), np.repeat(zero[mine[part]], n)
            b, b0 = p_of[peer], zero_of[peer]
            np.add.at(sums, of[peer], excess(a, b) - excess(a, b0) - excess(a0, b) + excess(a0, b0))
            met[of[peer]] = True
        met[g] = False
        found = np.flatnonzero(met)
        rows.append(np.full(len(found), g))
        items.append(found)
        values.append(sums[found])
    rows, items = np.concatenate(rows), np.concatenate(items)
    return pa.table(
        [pa.array([lang] * len(rows), pa.string()), names.take(pa.array(rows)),
         names.take(pa.array(items)), pa.array(np.concatenate(values), pa.int64())],
        names=["lang", "source", "item", "value"],
    )


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group (lang, source, total, kept, counts, terms, peers): what each pair has before the
    terms that both hold are corrected."""
    for batch in batches:
        for row in batch.to_pylist():
            peers = [x for x in row["peers"] if x["source"] != row["source"]]
            if not peers:
                continue
            count = np.array(row["counts"] or [], np.int64)
            terms = np.array(row["terms"] or [], np.int64)
            other = np.array([x["total"] for x in peers], np.int64)
            if row["kept"] == 0:
                forth = back = np.zeros(len(peers), np.int64)
            else:
                own, zero = probability(count, row["total"]), probability(0, row["total"])
                base = probability(np.zeros_like(other), other)
                both = excess(zero, base)
                forth, back = row["kept"] * both, np.zeros(len(peers), np.int64)
                reverse = excess(base, zero)
                for k in range(len(count)):
                    forth = forth + terms[k] * (excess(own[k], base) - both)
                    back = back + terms[k] * (excess(base, own[k]) - reverse)
            names = [x["source"] for x in peers]
            mine = [row["source"]] * len(peers)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["lang"]] * (2 * len(peers)), pa.string()),
                    pa.array(mine + names, pa.string()),
                    pa.array(names + mine, pa.string()),
                    pa.array(np.concatenate([forth, back]), pa.int64()),
                ],
                ["lang", "source", "item", "value"],
            )


def audit(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top: int = TOP,
    shard_postings: int = SHARD_POSTINGS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source stands from the other sources
    of its language, and the terms it holds more of than its language.

    Of `docs` the columns lang, source and text count, null as empty.  A language keeps the terms
    of at least `min_docs` of its documents.  p of a group is 1 + floor(UNIT (count + 1) /
    (N + V)); a pair's value sums floor((p - q)^2 / q) over all kept terms.  Each pair starts with
    the sum as if both groups held no common term (zero baselines, from the counts that occur in a
    group); each shard of the term-major index then adds the corrections of the common terms, by
    dense accumulators.  No pair of postings leaves a task, and a frequent term or a large source
    is spread over the shards by its terms.

    A language without kept terms has pairs of value 0; a source alone in its language has no pair;
    repeated rows count each; an empty table gives no rows.  Within a part, higher values rank
    first, then items by UTF-8.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    clean = docs.select(*map(text, ["lang", "source", "text"]))
    counts = stored(term_counts(clean), "term-counts")
    groups = clean.select("lang", "source").distinct()
    whole = (
        counts.groupBy("lang", "term")
        .agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.count("*").alias("groups"))
        .where(F.col("docs") >= min_docs)
    )
    kept = stored(
        counts.drop("docs").join(whole.select("lang", "term", "all"), ["lang", "term"]), "postings"
    )
    langs = (
        kept.groupBy("lang", "term")
        .agg(F.max("all").alias("all"), F.count("*").alias("postings"))
        .groupBy("lang")
        .agg(F.count("*").alias("kept"), F.sum("all").alias("n"), F.sum("postings").alias("postings"))
    )
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    stats = stored(
        groups.join(sums, ["lang", "source"], "left")
        .join(langs.withColumnRenamed("n", "lang_n"), "lang", "left")
        .select(
            "lang", "source",
            zero("kept").alias("kept"),
            (zero("n") + zero("kept")).alias("total"),
            (zero("lang_n") + zero("kept")).alias("lang_total"),
            (F.floor(zero("postings") / shard_postings) + 1).alias("shards"),
        ),
        "groups",
    )
    return _pairs(kept, stats).unionByName(_terms(kept, stats, top))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def _pairs(kept: DataFrame, stats: DataFrame) -> DataFrame:
    by = ["lang", "source"]
    counts = (
        kept.groupBy(*by, "count").agg(F.count("*").alias("terms"))
        .groupBy(*by).agg(F.collect_list("count").alias("counts"), F.collect_list("terms").alias("terms"))
    )
    # sources of a language, as many as each of its groups has rows in the result
    peers = stats.groupBy("lang").agg(F.collect_list(F.struct("source", "total")).alias("peers"))
    schema = "lang string, source string, item string, value bigint"
    base = (
        stats.select(*by, "kept", "total").join(counts, by, "left").join(peers, "lang")
        .mapInArrow(_baselines, schema)
    )
    shared = (
        kept.join(stats, by)
        .withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))
        .select(*by, "term", "count", "total", "shard")
        .groupBy("lang", "shard")
        .applyInArrow(_accumulate, schema)
    )
    summed = (
        base.unionByName(shared)
        .groupBy(*by, "item")
        .agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))
    )
    return _ranked(summed, "pair")


def _terms(kept: DataFrame, stats: DataFrame, top: int) -> DataFrame:
    p = probability_column(F.col("count"), F.col("total"))
    q = probability_column(F.col("all"), F.col("lang_total"))
    judged = (
        kept.join(stats, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where(F.col("p") > F.col("q"))
        .withColumn("value", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")))
    )
    return _ranked(judged, "term", top)


def op11(spark, sf_dir: str) -> DataFrame:
    """Every source's divergence from its peers, and its leading terms."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (
  SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.n, 0) + coalesce(v, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN vocabulary y ON y.lang = g.lang),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // g.total AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (y.n + y.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN vocabulary y ON y.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE c > 0 AND p > q)
SELECT * FROM (
  SELECT lang, source, part, item, value, CAST(row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""
