"""Phrases of frequent words from rows of word pairs.

A word of every document has a place list as long as the corpus.  The pair index has a row per
(first, second, document) for neighbours of which one is frequent; a phrase that holds a frequent
word reads the far shorter rows of its pairs and never the full list of that word.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import words


def frequent_terms(counts: DataFrame, one_in: int = 1_000) -> list[str]:
    """Words that make up at least one in `one_in` of all occurrences, so at most `one_in` words.

    `counts` are rows (term, occurrences), as `fulltext.document_frequency` gives them.
    """
    total = counts.agg(F.sum("occurrences")).scalar()
    often = counts.where(F.col("occurrences") * one_in >= total)
    return sorted(r["term"] for r in often.select("term").collect())


def build_pairs(
    docs: DataFrame,
    frequent: Sequence[str],
    id_col: str = "posting_id",
    title: str = "title",
    body: str = "body",
) -> DataFrame:
    """Rows `(first, second, posting_id, positions)` of neighbours with a frequent word.

    Positions are those of the first word and go on from the title into the body, as in
    `fulltext.build_index`.  Null and empty texts have no rows.  A pair of one document is grouped
    by the document, so a pair of all documents is no hot group.
    """
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(words(F.col(title)), empty), F.coalesce(words(F.col(body)), empty))
    # a row of its own, so that the words are cut once
    cut = docs.select(F.col(id_col).alias("posting_id"), F.explode_outer(F.array(both)).alias("_w"))
    pair = F.transform(
        F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))),
        lambda second, i: F.struct(F.get("_w", i).alias("first"), second.alias("second")),
    )
    at = cut.select("posting_id", F.posexplode_outer(pair).alias("at", "_p"))
    listed = [*frequent]
    kept = at.where(F.col("_p.first").isin(*listed) | F.col("_p.second").isin(*listed))
    return (
        kept.select("_p.first", "_p.second", "posting_id", "at")
        .groupBy("first", "second", "posting_id")
        .agg(F.sort_array(F.collect_list("at")).alias("positions"))
    )


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Stored by pair; a pair of every document is spread over several files."""
    order = ["first", "second", "posting_id"]
    pairs.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def reading(phrase: Sequence[str], frequent: Sequence[str]) -> tuple[dict[int, tuple[str, str]], dict[int, str]]:
    """What a phrase reads: pairs by their place in it, and single words where no pair covers them.

    Every frequent word is covered by a pair, unless the phrase is that word alone.
    """
    often = set(frequent)
    pairs = {
        i: (a, b) for i, (a, b) in enumerate(zip(phrase, phrase[1:])) if a in often or b in often
    }
    covered = {j for i in pairs for j in (i, i + 1)}
    return pairs, {i: w for i, w in enumerate(phrase) if i not in covered}


def phrase_match(
    pairs: DataFrame,
    index: DataFrame | None,
    phrases: Sequence[Sequence[str]],
    frequent: Sequence[str],
) -> DataFrame:
    """Documents `(posting_id)` with every phrase, as `fulltext.text_match(phrases=...)` finds them.

    `index` is read for words that no pair covers; it may be None where there are none.
    """
    if not phrases or not all(phrases):
        raise ValueError("nothing to search for")
    plans = [reading(p, frequent) for p in phrases]
    wanted = sorted({pair for got, _ in plans for pair in got.values()})
    single = sorted({w for _, alone in plans for w in alone.values()})
    if single and index is None:
        raise ValueError(f"no pair covers {single[0]!r}: an index of words is needed")
    parts = []
    if wanted:
        # plain comparisons of both columns, which the store's statistics serve
        hit = reduce(
            lambda a, b: a | b, [(F.col("first") == a) & (F.col("second") == b) for a, b in wanted]
        )
        parts.append(pairs.where(hit).select("posting_id", "first", "second", "positions"))
    if single:
        rows = index.where(F.col("term").isin(*single))
        parts.append(
            rows.select("posting_id", F.col("term").alias("first"), F.lit("").alias("second"), "positions")
        )
    row = F.struct("first", "second", "positions")
    grouped = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("posting_id")
        .agg(F.collect_list(row).alias("_rows"))
    )

    def places(first: str, second: str, shift: int):
        own = F.filter("_rows", lambda r: (r["first"] == first) & (r["second"] == second))
        return F.transform(F.flatten(own["positions"]), lambda p: p - shift)

    for got, alone in plans:
        lists = [places(a, b, i) for i, (a, b) in got.items()]
        lists += [places(w, "", i) for i, w in alone.items()]
        grouped = grouped.where(F.size(reduce(F.array_intersect, lists)) > 0)
    return grouped.select("posting_id")
