"""Full-text search over a table of word occurrences.

The index has one row per (term, document, field) with the word positions; stored sorted by
term, its Parquet statistics let a search read only the files of its words.  A search groups
the rows of its own words by document, so no group is larger than one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.fields import clamp_limit
from tidemark.functions.text import words
from tidemark.operators.filters import search_filter
from tidemark.operators.stem import STOP_WORDS, stem_forms, stem_index
from tidemark.sources.clustered import Clustered
from tidemark.sources.shared import stored

#: Weight of a word in the title and in the body.
FIELD_WEIGHT = {"A": 1.0, "B": 0.4}

#: Words of documents that are sorted at once in batches: some 10 MB of a Python worker.
SLICE_WORDS = 100_000


def build_index(
    docs: DataFrame,
    id_col: str = "posting_id",
    title: str = "title",
    body: str = "body",
    terms: Sequence[str] | None = None,
    in_batches: bool = False,
) -> DataFrame:
    """Occurrence rows `(term, posting_id, field, positions)`; body positions follow the title's.

    The words of a document are sorted and cut into runs of equal words inside its row, so no
    text and no word is shuffled.  With `terms`, only their places are kept, before anything is
    sorted, and grouped by document: what a search over texts without a stored index needs.

    With `in_batches`, the words of many documents are sorted at once as numbers, in a third of the
    time.  Spark then no longer knows how the documents were dealt out; without, it does.
    """
    empty = F.array().cast("array<string>")
    cut_words = F.struct(
        F.coalesce(words(F.col(title)), empty).alias("title"),
        F.coalesce(words(F.col(body)), empty).alias("body"),
    )
    # as rows of their own, arrays are made once, however often they are looked at
    texts = docs.select(F.col(id_col).alias("posting_id"), F.explode_outer(F.array(cut_words)).alias("_t"))
    if in_batches and terms is None:
        split = texts.select("posting_id", F.col("_t.title").alias("title"), F.col("_t.body").alias("body"))
        return split.mapInArrow(_occurrences, _occurrence_type(docs.schema[id_col].dataType))
    counted = texts.select(
        "posting_id", F.size("_t.title").alias("_n"), F.concat("_t.title", "_t.body").alias("_w")
    )
    in_field = lambda at: F.when(at < F.col("_n"), "A").otherwise("B")
    if terms is not None:
        hits = counted.select("posting_id", "_n", F.posexplode_outer("_w").alias("at", "term"))
        hits = hits.where(F.col("term").isin(*terms)).select(
            "term", "posting_id", in_field(F.col("at")).alias("field"), "at"
        )
        # by document alone: searches group by document next and need no further exchange
        return (
            hits.repartition("posting_id")
            .groupBy("term", "posting_id", "field")
            .agg(F.sort_array(F.collect_list("at")).alias("positions"))
        )
    place = F.transform(
        "_w",
        lambda w, i: F.struct(w.alias("term"), in_field(i).alias("field"), i.alias("at")),
    )
    placed = counted.where(F.size("_w") > 0).select(
        "posting_id", F.explode_outer(F.array(F.sort_array(place))).alias("_s")
    )
    s = F.col("_s")
    key = F.transform(s, lambda x: F.struct(x["term"], x["field"]))
    keyed = placed.select(
        "posting_id", F.explode_outer(F.array(F.struct(key.alias("k"), s["at"].alias("at")))).alias("_s")
    ).select("posting_id", F.col("_s.k").alias("_k"), F.col("_s.at").alias("_at"))
    k, n = F.col("_k"), F.size("_k")
    heads = F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (k[i] != k[F.greatest(i - 1, F.lit(0))])
    )
    cut = keyed.select("posting_id", "_at", "_k", F.explode_outer(F.array(heads)).alias("_h"))
    h = F.col("_h")
    runs = F.transform(
        h,
        lambda begin, j: F.struct(
            k[begin].alias("key"),
            F.slice("_at", begin + 1, F.coalesce(F.get(h, j + 1), n) - begin).alias("positions"),
        ),
    )
    return cut.select("posting_id", F.explode_outer(runs).alias("_r")).select(
        "_r.key.term", "posting_id", "_r.key.field", "_r.positions"
    )


def _occurrence_type(key: T.DataType) -> T.StructType:
    row = T.StructType().add("term", "string").add("posting_id", key).add("field", "string")
    return row.add("positions", T.ArrayType(T.IntegerType()))


def _word_counts(part: pa.RecordBatch) -> list[np.ndarray]:
    sizes = [pc.list_value_length(part.column(c)) for c in ("title", "body")]
    return [n.to_numpy(zero_copy_only=False).astype(np.int64) for n in sizes]


def _word_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some SLICE_WORDS words each; a document stays whole."""
    ends, start = np.cumsum(sum(_word_counts(batch))), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + SLICE_WORDS, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of `(posting_id, title, body)` rows of words.

    Words become numbers that are sorted stably by document, word and field, so the places of a
    word stand in order.
    """
    for part in (some for batch in batches for some in _word_slices(batch)):
        sizes = _word_counts(part)
        coded = pa.concat_arrays([part.column(c).flatten() for c in ("title", "body")]).dictionary_encode()
        docs, places = [], []
        for n, before in zip(sizes, (np.zeros_like(sizes[0]), sizes[0])):
            docs.append(np.repeat(np.arange(len(n)), n))
            places.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - before, n))
        doc, in_body = np.concatenate(docs), np.arange(len(coded)) >= len(docs[0])
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = (doc * len(coded.dictionary) + code) * 2 + in_body
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = order[heads]
        ends = pa.array(np.append(heads, len(order)).astype(np.int32))
        at = pa.array(np.concatenate(places)[order].astype(np.int32))
        columns = {
            "term": coded.dictionary.take(pa.array(code[first])),
            "posting_id": part.column("posting_id").take(pa.array(doc[first])),
            "field": pa.array(["A", "B"]).take(pa.array(in_body[first].astype(np.int8))),
            "positions": pa.ListArray.from_arrays(ends, at),
        }
        yield pa.RecordBatch.from_pydict(columns)


def write_index(index: DataFrame, path: str) -> None:
    """Store sorted by term; a word found in every document is spread over several files."""
    (
        index.repartitionByRange("term", "posting_id")
        .sortWithinPartitions("term", "posting_id")
        .write.mode("overwrite")
        .parquet(path)
    )


def refresh_index(index: DataFrame, docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Index with the documents named in `changed` built anew (or gone, if not in `docs`)."""
    # hashed: a task holds its part of the names, and sorts no rows of the index
    named = changed.select("posting_id").distinct().hint("shuffle_hash")
    kept = index.join(named, "posting_id", "left_anti")
    redo = docs.join(named, "posting_id", "left_semi")
    return kept.unionByName(build_index(redo))


def document_frequency(index: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    per_doc = index.groupBy("term", "posting_id").agg(F.sum(F.size("positions")).alias("n"))
    return per_doc.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences")
    )


def split_words(text: str | None, stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    """Words of a plain search text, all of them required; stop words are left out."""
    found = re.findall(r"\w+", (text or "").lower())
    return [w for w in found if w.replace("ё", "е") not in stop_words]


def text_match(
    index: DataFrame,
    all_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    phrases: Sequence[Sequence[str]] = (),
    universe: DataFrame | None = None,
) -> DataFrame:
    """Documents with all of the words, none of others, any of others, and whole phrases.

    One pass: the rows of all mentioned words are grouped by document once.  With only
    excluded words, `universe` names the documents to choose from.
    """
    if not (all_of or any_of or phrases):
        if universe is None:
            raise ValueError("a search for absent words needs the documents to choose from")
        bad = index.where(F.col("term").isin(*none_of)).select("posting_id")
        return universe.select("posting_id").join(bad, "posting_id", "left_anti")
    return _matches(index, all_of, none_of, any_of, phrases).select("posting_id")


def _shifted(positions: Column, shift: int) -> Column:
    return F.transform(positions, lambda p: p - shift)


def _matches(
    index: DataFrame,
    all_of: Sequence[str],
    none_of: Sequence[str],
    any_of: Sequence[str],
    phrases: Sequence[Sequence[str]],
) -> DataFrame:
    """`(posting_id, _rows)` of the matching documents: their index rows of the mentioned words."""
    wanted = [*all_of, *any_of, *(w for p in phrases for w in p)]
    if not wanted:
        raise ValueError("nothing to search for")
    rows = F.collect_list(F.struct("term", "field", "positions")).alias("_rows")
    grouped = index.where(F.col("term").isin(*wanted, *none_of)).groupBy("posting_id").agg(rows)
    found = F.col("_rows")["term"]
    for word in dict.fromkeys([*all_of, *(w for p in phrases for w in p)]):
        grouped = grouped.where(F.array_contains(found, F.lit(word)))
    if none_of:
        grouped = grouped.where(~F.arrays_overlap(found, F.array(*map(F.lit, none_of))))
    if any_of:
        grouped = grouped.where(F.arrays_overlap(found, F.array(*map(F.lit, any_of))))

    def places(word: str) -> Column:
        return F.flatten(F.filter("_rows", lambda r: r["term"] == word)["positions"])

    for phrase in phrases:
        starts = None
        for shift, word in enumerate(phrase):
            at = places(word)
            at = _shifted(at, shift) if shift else at
            starts = at if starts is None else F.array_intersect(starts, at)
        grouped = grouped.where(F.size(starts) > 0)
    return grouped


def query_terms(spark: SparkSession, queries: Mapping[str, Sequence[str]]) -> DataFrame:
    """Search words as rows `(query_id, term, ordinal, n_terms)`; repeated words count once."""
    wanted = {q: list(dict.fromkeys(terms)) for q, terms in queries.items()}
    rows = [(q, t, i, len(terms)) for q, terms in wanted.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "query_id string, term string, ordinal int, n_terms int")


def _weight(field: Column) -> Column:
    return F.when(field == "A", FIELD_WEIGHT["A"]).otherwise(FIELD_WEIGHT["B"])


def _hits(rows: Column, ordinal: Callable[[Column], Column]) -> Column:
    """Hits `(pos, ordinal, weight)` of index rows in text order; `ordinal` gives a row's word."""
    each = F.transform(
        rows,
        lambda r: F.transform(
            r["positions"],
            lambda p: F.struct(
                p.alias("pos"), ordinal(r).alias("ordinal"), _weight(r["field"]).alias("weight")
            ),
        ),
    )
    return F.sort_array(F.flatten(each))


def _covers(hits: Column, n: Column, more: Callable[[Column, Column, Column, Column], Column], start: Column) -> Column:
    """Fold over the minimal covers of a document: `more(state, begin, end, mean_weight)`.

    One scan with two pointers: `last` holds the latest place of each of the `n` words, its
    smallest is the begin of the tightest stretch that ends at the current hit.  Of the stretches
    with one begin the first is the shortest, so a stretch counts when its begin is new.
    """
    unseen = F.struct(F.lit(-1).alias("pos"), F.lit(0.0).alias("weight"))

    def step(state: Column, hit: Column) -> Column:
        here = F.struct(hit["pos"].alias("pos"), hit["weight"].alias("weight"))
        last = F.transform(
            state["last"], lambda x, i: F.when(i == hit["ordinal"], here).otherwise(x)
        )
        return F.struct(
            last.alias("last"), F.array_min(last["pos"]).alias("low"),
            state["low"].alias("before"), hit["pos"].alias("at"), state["out"].alias("out"),
        )

    def judged(state: Column) -> Column:
        mean = F.aggregate(state["last"], F.lit(0.0), lambda a, x: a + x["weight"]) / n
        fresh = (state["low"] >= 0) & (state["low"] != state["before"])
        out = F.when(fresh, more(state["out"], state["low"], state["at"], mean)).otherwise(state["out"])
        return F.struct(
            state["last"].alias("last"), state["low"].alias("low"), state["low"].alias("before"),
            state["at"].alias("at"), out.alias("out"),
        )

    blank = F.struct(
        F.array_repeat(unseen, n.cast("int")).alias("last"), F.lit(-1).alias("low"),
        F.lit(-1).alias("before"), F.lit(-1).alias("at"), start.alias("out"),
    )
    # a step and its judgement are two links of the fold, so that `last` is made once a hit
    return F.aggregate(
        hits,
        blank,
        lambda state, hit: F.element_at(F.transform(F.array(step(state, hit)), judged), 1),
        lambda state: state["out"],
    )


def _cover_rank(hits: Column, n: Column) -> Column:
    """Sum over minimal covers of the mean weight by one plus the other words inside."""
    def more(total: Column, begin: Column, end: Column, mean: Column) -> Column:
        return total + mean / (1 + (end - begin + 1 - n))

    one = F.aggregate(hits, F.lit(0.0), lambda total, hit: total + hit["weight"])
    many = _covers(hits, n, more, F.lit(0.0))
    return F.round(F.when(n == 1, one).otherwise(many), 9)


def _query_hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """`(query_id, posting_id, n_terms, _hits)` of documents with every word of a query."""
    return _grouped_hits(index.join(terms, "term"))


def _grouped_hits(rows: DataFrame) -> DataFrame:
    row = F.struct("ordinal", "field", "positions")
    grouped = (
        rows.groupBy("query_id", "posting_id", "n_terms")
        .agg(F.collect_list(row).alias("_rows"))
        .where(F.size(F.array_distinct(F.col("_rows")["ordinal"])) == F.col("n_terms"))
    )
    hits = _hits(F.col("_rows"), lambda r: r["ordinal"])
    # as a row of its own, the sorted array is made once, however often it is looked at
    return grouped.select(
        "query_id", "posting_id", "n_terms", F.explode_outer(F.array(hits)).alias("_hits")
    )


def candidate_documents(index: DataFrame, terms: DataFrame) -> DataFrame:
    """`(query_id, posting_id)` of the documents with the rarest word of a query, if all occur at all.

    A document with every word of a query has its rarest one, so only these need their other words
    looked up: frequent words of a long query then meet the few documents it can match.  The rarest
    words are stored in the shared folder, so that Spark knows how few they are.
    """
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = (
        terms.join(counted, "term")
        .groupBy("query_id", "n_terms")
        .agg(F.min_by("term", F.struct("_rows", "term")).alias("term"), F.count(F.lit(1)).alias("_known"))
        .where(F.col("_known") == F.col("n_terms"))
        .select("query_id", "term")
    )
    rarest = stored(rarest, "rarest-words")
    return index.select("term", "posting_id").join(rarest, "term").select("query_id", "posting_id").distinct()


def minimal_covers(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Shortest stretches of a document that hold every word of a query.

    `terms` comes from `query_terms` or has its columns.  Rows
    `(query_id, posting_id, begin, end, n_terms, mean_weight)`.  The index rows of a document's
    query words meet in one row; a single scan over their merged places finds the covers.
    """
    kind = "array<struct<begin:int,end:int,mean_weight:double>>"
    found = _covers(
        F.col("_hits"),
        F.col("n_terms"),
        lambda out, begin, end, mean: F.concat(
            out,
            F.array(F.struct(begin.alias("begin"), end.alias("end"), mean.alias("mean_weight"))),
        ),
        F.array().cast(kind),
    )
    rows = _query_hits(index, terms).select(
        "query_id", "posting_id", "n_terms", F.explode_outer(found).alias("c")
    )
    return rows.select("query_id", "posting_id", "c.begin", "c.end", "n_terms", "c.mean_weight")


def rank_long_queries(index: DataFrame, terms: DataFrame) -> DataFrame:
    """`rank_terms` for queries of many words.  The index rows of their words are stored in the shared
    folder, and read for the documents with the rarest word of each query alone.  These candidates
    are stored too: Spark then knows how few they are, and leaves the rows of other documents where
    they lie."""
    words_ = terms.select("term").distinct()
    own = stored(index.join(words_, "term", "left_semi"), "query-words")
    found = stored(candidate_documents(own, terms), "candidates")
    near = own.join(found.select("posting_id"), "posting_id", "left_semi")
    return _ranked(_grouped_hits(near.join(found.join(terms, "query_id"), ["term", "posting_id"])))


def rank_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Cover-density rank `(query_id, posting_id, rank)` of documents with all query words.

    After Clarke, Cormack and Tudhope (2000): the sum over minimal covers of the mean word
    weight divided by one plus the number of other words inside the cover.  One word gives the
    sum of its weights.  Rounded, so that ranks tie whatever the order of summation.
    """
    return _ranked(_query_hits(index, terms))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "posting_id", _cover_rank(F.col("_hits"), F.col("n_terms")).alias("rank")
    )


def text_rank(index: DataFrame, queries: Mapping[str, Sequence[str]]) -> DataFrame:
    """`rank_terms` for queries given as word lists; only their words are read."""
    listed = sorted({t for words_ in queries.values() for t in words_})
    return rank_terms(
        index.where(F.col("term").isin(*listed)), query_terms(index.sparkSession, queries)
    )


def any_rank(index: DataFrame, any_of: Sequence[str]) -> DataFrame:
    """Rank of documents with any of the words: the sum of the weights of all their places."""
    hits = index.where(F.col("term").isin(*any_of))
    weighed = F.sum(_weight(F.col("field")) * F.size("positions"))
    return hits.groupBy("posting_id").agg(weighed.alias("rank"))


SUMMARY = (
    "posting_id",
    "title",
    "employer_name",
    "area_name",
    "salary_from_base",
    "salary_to_base",
    "salary_currency",
    "experience_name",
    "is_remote",
    "published_at",
    "url",
    "description",
    "rank",
)


def search_postings(
    postings: DataFrame,
    employers: DataFrame | None = None,
    index: DataFrame | None = None,
    text: str | None = None,
    *,
    none_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    phrases: Sequence[Sequence[str]] = (),
    limit: int = 20,
    offset: int = 0,
    max_limit: int | None = None,
    columns: Sequence[str] = SUMMARY,
    stop_words: frozenset[str] = STOP_WORDS,
    vocabulary: DataFrame | None = None,
    now: datetime | Column | None = None,
    store: Clustered | None = None,
    **filters,
) -> DataFrame:
    """Filtered, ranked search.  Without a text the newest postings come first.

    Text hits meet only the keys and dates of the filtered postings; the wide columns are read
    for the best rows alone, and the employer names are joined to them.  How these joins are made
    is left to adaptive execution, which knows the size of the cut result.  With a `store` of the
    postings by key ranges, only the files of the best rows are opened for their wide columns;
    `postings` then need no more than the columns of the filters.  With a `vocabulary` of `(term, stem)` all
    words are searched by their stems.  `max_limit`, if given, holds `limit` down.  A text of
    stop words alone finds nothing.
    """
    terms = split_words(text, stop_words)
    found = search_filter(postings, now=now, **filters)
    if split_words(text, frozenset()) and not (terms or any_of or phrases):
        found = found.where(F.lit(False))
    if vocabulary is not None:
        mentioned = {*terms, *none_of, *any_of, *(w for p in phrases for w in p)}
        forms = stem_forms(vocabulary, mentioned) if mentioned else {}
        terms, none_of, any_of = ([forms[w] for w in ws] for ws in (terms, none_of, any_of))
        phrases = [[forms[w] for w in p] for p in phrases]
        index = stem_index(index, vocabulary, forms) if mentioned else index
    hits = _ranked_hits(index, terms, none_of, any_of, phrases, found)
    limit = clamp_limit(limit, max_limit)
    order = [F.desc_nulls_last("rank"), F.desc_nulls_last("published_at"), F.asc("posting_id")]
    source = postings if store is None else store.rows()
    wide = [c for c in columns if c in source.columns]
    wide += [c for c in ("employer_id", "published_at", "posting_id") if c not in wide and c in source.columns]

    def cut(rows: DataFrame) -> DataFrame:
        return rows.orderBy(*order).offset(max(0, offset)).limit(limit)

    if hits is None and store is None:
        top = cut(found.select(*wide, F.lit(None).cast("double").alias("rank")))
    else:
        narrow = found.select("posting_id", "published_at")
        if hits is None:
            best = cut(narrow.withColumn("rank", F.lit(None).cast("double")))
        else:
            best = cut(narrow.join(hits, "posting_id"))
        best = best.select("posting_id", "rank")
        if store is not None:
            best = stored(best, "best")
            source = store.lookup(best, wide)
        top = source.select(*wide).join(best, "posting_id")
    if employers is None or "employer_id" not in wide:
        named = top.withColumn("employer_name", F.lit(None).cast("string"))
    else:
        names = employers.select("employer_id", "employer_name")
        named = top.join(names, "employer_id", "left")
    absent = [c for c in columns if c not in named.columns]
    for name in absent:
        named = named.withColumn(name, F.lit(None).cast("string"))
    return named.orderBy(*order).select(*columns)


def _ranked_hits(
    index: DataFrame | None,
    terms: Sequence[str],
    none_of: Sequence[str],
    any_of: Sequence[str],
    phrases: Sequence[Sequence[str]],
    universe: DataFrame,
) -> DataFrame | None:
    """Matching documents with their rank; null ranks where only absent words are asked for."""
    needed = list(terms) + [w for p in phrases for w in p]
    if not needed and not any_of:
        if not none_of:
            return None
        absent = text_match(index, none_of=none_of, universe=universe)
        return absent.withColumn("rank", F.lit(None).cast("double"))
    if not needed:
        ranks = any_rank(index, any_of)
        if none_of:
            bad = index.where(F.col("term").isin(*none_of)).select("posting_id")
            ranks = ranks.join(bad, "posting_id", "left_anti")
        return ranks
    # one grouping by document serves the match and the rank
    ranked = list(dict.fromkeys(needed))
    own = F.filter("_rows", lambda r: r["term"].isin(*ranked))
    place = F.array(*map(F.lit, ranked))
    hits = _hits(own, lambda r: F.array_position(place, r["term"]).cast("int") - 1)
    matched = _matches(index, terms, none_of, any_of, phrases).select(
        "posting_id", F.explode_outer(F.array(hits)).alias("_hits")
    )
    return matched.select(
        "posting_id", _cover_rank(F.col("_hits"), F.lit(len(ranked))).alias("rank")
    )
