"""Retrieval quality: ground truth, recall, precision, reciprocal rank, failures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import words
from tidemark.operators.fulltext import rank_long_queries
from tidemark.operators.ranking import top_k_within
from tidemark.operators.vectors import fuse_hits, semantic_search
from tidemark.sources.shared import stored

#: The searches that `method_rankings` judges.
SEARCHES = ("text", "semantic", "hybrid")

#: Stands for the end of a literal run, and before a character that is meant as itself.
_BREAK, _SELF = "\ue001", "\ue000"
#: Characters of a gram of the second tier.
GRAM = 4


def java_pattern(pattern: Column) -> Column:
    """A labelled pattern for Spark's regular expressions: classes and case by Unicode, as the labels
    mean them, and named groups in Java's spelling."""
    named = F.replace(F.replace(pattern, F.lit("(?P<"), F.lit("(?<")), F.lit("(?P="), F.lit("\\k<"))
    return F.concat(F.lit("(?U)"), named)


def literal_runs(pattern: Column) -> Column:
    """Stretches of literal characters that every match of a pattern holds, folded by case.

    What is optional or repeated, classes, dots and anchors end a run.  Alternatives, groups and
    escapes by number give no run: such a pattern says too little by its letters alone.
    """
    own = rf"(?<!{_SELF})"
    more = r"(?:[*+?]|\{[^}]*\})"
    plain = F.regexp_replace(pattern, r"^\(\?[a-zA-Z]+\)", "")
    plain = F.regexp_replace(plain, r"\\([^a-zA-Z0-9])", f"{_SELF}$1")
    unclear = plain.rlike(rf"{own}[|(]|\\[xuUNQEcCk0-9]")
    for ends in (
        rf"{own}\[\^?\]?[^\]]*\]{more}*",
        rf"\\(?:[pP]\{{[^}}]*\}}|[a-zA-Z]){more}*",
        rf"{_SELF}?[\s\S]{own}{more}+",
        rf"{own}[.^$]",
    ):
        plain = F.regexp_replace(plain, ends, _BREAK)
    runs = F.split(F.lower(F.replace(plain, F.lit(_SELF), F.lit(""))), _BREAK)
    return F.when(unclear, F.array().cast("array<string>")).otherwise(runs)


def _longest(words: Column) -> Column:
    """The longest of some words, of equally long ones the first by letters; null if none."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.array_min(keyed)["w"]


def required_grams(queries: DataFrame) -> DataFrame:
    """`(query_id, pattern, word, gram)`: what a title must hold to match a pattern.

    `word` is a whole word between two blanks of a literal run, `gram` a part of GRAM characters of
    the longest run, for patterns without such a word.  The longest word stands for the
    rarest.  With neither, the pattern needs a full pass over the titles.
    """
    rows = queries.select("query_id", F.explode("patterns").alias("pattern")).where(
        F.col("pattern").isNotNull()
    )
    runs = literal_runs(F.col("pattern"))
    inner = F.flatten(
        F.transform(runs, lambda r: F.slice(F.split(r, " "), 2, F.greatest(F.size(F.split(r, " ")) - 2, F.lit(0))))
    )
    word = _longest(F.filter(inner, lambda w: w != ""))
    run = _longest(F.filter(runs, lambda r: F.length(r) >= GRAM))
    # the middle of a run: beginnings of words are shared by many more titles
    part = F.substr(run, ((F.length(run) - GRAM) / 2).cast("int") + 1, F.lit(GRAM))
    return rows.select("query_id", "pattern", word.alias("word"), F.when(word.isNull(), part).alias("gram"))


def ground_truth(queries: DataFrame, postings: DataFrame, title: str = "title") -> DataFrame:
    """Relevant `(query_id, posting_id)` pairs.

    Explicit ids count as they are.  A query without ids takes the postings whose title one of
    its patterns is found in.  Titles are cut into words, or into grams of GRAM characters, and
    joined with the word or gram that a pattern requires; the pattern is tried on these
    candidates alone.  Patterns that require neither meet every title; this third part is
    empty, and costs nothing, where there are none.  Null titles and patterns match nothing.
    """
    explicit = queries.where(F.size("relevant_ids") > 0).select(
        "query_id", F.explode("relevant_ids").alias("posting_id")
    )
    searched = queries.where((F.size("relevant_ids") == 0) & (F.size("patterns") > 0))
    needs = required_grams(searched)
    titles = postings.where(F.col(title).isNotNull()).select(
        F.col("posting_id").cast("bigint").alias("posting_id"), F.col(title).alias("_title")
    )
    folded = F.lower("_title")
    by_word = titles.select("posting_id", "_title", F.explode_outer(F.split(folded, " ")).alias("word"))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(folded) - GRAM + 1, F.lit(1))),
        lambda i: F.substr(folded, i, F.lit(GRAM)),
    )
    by_gram = titles.select("posting_id", "_title", F.explode_outer(grams).alias("gram"))
    found = [
        by_word.join(needs.where(F.col("word").isNotNull()).select("query_id", "pattern", "word"), "word"),
        by_gram.join(needs.where(F.col("gram").isNotNull()).select("query_id", "pattern", "gram"), "gram"),
        titles.join(needs.where(F.col("word").isNull() & F.col("gram").isNull()), how="inner"),
    ]
    matched = [
        rows.where(F.rlike(F.col("_title"), java_pattern(F.col("pattern")))).select("query_id", "posting_id")
        for rows in found
    ]
    return reduce(DataFrame.unionByName, [explicit, *matched]).distinct()


def whole_text_terms(queries: DataFrame) -> DataFrame:
    """`(query_id, term, ordinal, n_terms)`: every distinct word of the text of a query.

    A null text, or one without words, asks for nothing and has no row.
    """
    listed = F.array_distinct(words(F.col("query")))
    rows = queries.where(F.col("query").isNotNull()).select(
        "query_id", F.size(listed).alias("n_terms"), F.posexplode_outer(listed).alias("ordinal", "term")
    )
    return rows.where(F.col("term").isNotNull()).select("query_id", "term", "ordinal", "n_terms")


def method_rankings(
    index: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    limit: int = 10,
    semantic_weight: float = 0.5,
    depth: int | None = None,
) -> DataFrame:
    """`(method, query_id, posting_id, rank)`: what the three searches return for whole query texts.

    `queries` has `query_id` and `query`, `vectors` the `query_id` and `embedding` of its texts.
    Text search asks for all words of the text in `index`, semantic search for the best chunk of
    each posting, hybrid search fuses the first `depth` of both, four times `limit` unless given,
    as `hybrid_search` does.  Both lists, at most `depth` rows a query, are stored in the shared
    folder, so that texts and vectors are searched once.
    """
    depth = 4 * limit if depth is None else depth
    ranked = rank_long_queries(index, whole_text_terms(queries)).withColumnRenamed("rank", "score")
    best_first = [F.desc("score"), F.asc("posting_id")]
    text = stored(top_k_within(ranked, "query_id", best_first, depth), "text-hits")
    near = stored(semantic_search(chunks, vectors, limit=depth), "near-hits")
    found = dict(zip(SEARCHES, (text, near, fuse_hits(text, near, limit, semantic_weight))))
    parts = [
        rows.where(F.col("rank") <= limit).select(F.lit(name).alias("method"), "query_id", "posting_id", "rank")
        for name, rows in found.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _per_query(
    rankings: DataFrame, truth: DataFrame, methods: Sequence[str], ks: Sequence[int]
) -> DataFrame:
    """One row per method and query with a ground truth: its size, hits per k, first hit.

    Relevant pairs and ranked pairs are stacked and grouped by (query, posting) once, so the
    ground truth is read a single time; each pair then holds at most one rank per method.
    """
    relevant = truth.select(
        "query_id",
        "posting_id",
        F.lit(True).alias("relevant"),
        F.lit(None).cast("string").alias("method"),
        F.lit(None).cast("int").alias("rank"),
    )
    top = rankings.where(F.col("rank") <= max(ks)).select(
        "query_id", "posting_id", F.lit(False).alias("relevant"), "method", "rank"
    )
    rank_of = [
        F.min(F.when(F.col("method") == m, F.col("rank"))).alias(f"_r{i}")
        for i, m in enumerate(methods)
    ]
    pairs = (
        relevant.unionByName(top)
        .groupBy("query_id", "posting_id")
        .agg(F.bool_or("relevant").alias("relevant"), *rank_of)
        .where(F.col("relevant"))
    )
    by_method = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.col(f"_r{i}").alias("rank"))
            for i, m in enumerate(methods)
        ]
    )
    return (
        pairs.select("query_id", F.inline(by_method))
        .groupBy("method", "query_id")
        .agg(
            F.count(F.lit(1)).alias("expected"),
            F.min("rank").alias("first_hit"),
            *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks],
        )
    )


def evaluate_rankings(
    rankings: DataFrame,
    truth: DataFrame,
    queries: DataFrame,
    methods: Sequence[str],
    ks: Sequence[int] = (1, 5, 10),
) -> DataFrame:
    """Metrics in long form `(method, metric, k, value)`, all methods and queries in one job.

    Precision always divides by k.  Queries without a ground truth are counted as skipped and
    do not enter the averages; with none evaluated all metrics are 0.
    """
    per_query = _per_query(rankings, truth, methods, ks)
    cells: list[Column] = []

    def cell(metric: str, k: int | None, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(k).cast("int").alias("k"),
            F.coalesce(value, F.lit(0.0)).cast("double").alias("value"),
        )

    aggregates = [F.count(F.lit(1)).alias("evaluated")]
    for k in ks:
        hits = F.col(f"hits_{k}")
        aggregates.append(F.avg(hits / F.col("expected")).alias(f"recall_{k}"))
        aggregates.append(F.avg(hits / F.lit(k)).alias(f"precision_{k}"))
        cells.append(cell("recall", k, F.col(f"recall_{k}")))
        cells.append(cell("precision", k, F.col(f"precision_{k}")))
    aggregates.append(F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("mrr"))
    cells.append(cell("mrr", None, F.col("mrr")))
    evaluated = F.coalesce("evaluated", F.lit(0))
    cells.append(cell("evaluated", None, evaluated))
    cells.append(cell("skipped", None, queries.agg(F.count(F.lit(1))).scalar() - evaluated))

    measured = per_query.groupBy("method").agg(*aggregates)
    every = queries.sparkSession.createDataFrame([(m,) for m in methods], "method string")
    return (
        every.join(measured, "method", "left")
        .select("method", F.explode(F.array(*cells)).alias("cell"))
        .select("method", "cell.*")
    )


def retrieval_failures(
    rankings: DataFrame,
    truth: DataFrame,
    postings: DataFrame,
    queries: DataFrame,
    methods: Sequence[str],
    ks: Sequence[int] = (1, 5, 10),
) -> DataFrame:
    """Queries with no relevant posting near the top, with what came back instead.

    The top is 5 where 5 is one of `ks`, else the largest; only that many rows per method
    and query are listed.
    """
    depth = 5 if 5 in ks else max(ks)
    missed = _per_query(rankings, truth, methods, [depth]).where(F.col(f"hits_{depth}") == 0)
    shown = (
        rankings.where(F.col("rank") <= depth)
        .join(postings.select("posting_id", "title"), "posting_id", "left")
        .groupBy("method", "query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rank", "posting_id", F.coalesce("title", F.lit("?")).alias("title"))
                )
            ).alias("returned")
        )
    )
    return (
        missed.select("method", "query_id", "expected")
        .join(shown, ["method", "query_id"], "left")
        .join(queries.select("query_id", "query", "intent"), "query_id")
        .select("method", "query_id", "query", "intent", "expected", "returned")
    )
