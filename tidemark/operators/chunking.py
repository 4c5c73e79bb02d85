"""Cutting texts into overlapping chunks at sentence ends, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import SPACE, strip

#: A line end, or the space after a sentence end.
_BOUNDARY = rf"{SPACE}*\n{SPACE}*|(?<=[.!?…]){SPACE}+"


def sentences(text: Column) -> Column:
    """Trimmed sentences in order; no sentence crosses a line.

    A boundary takes all the white space around it, so only the text itself needs trimming.
    """
    return F.filter(F.split(strip(text), _BOUNDARY), lambda s: s != "")


def _pieces(sentence: Column, budget: Column) -> Column:
    """A long sentence cut between words; a longer word stays whole.

    One pattern takes as much as fits and ends before a space, so the time is linear.  Where other
    white space touches a space, a fold over the words strips it as it joins them.
    """
    plain = F.regexp_replace(sentence, " +", " ")
    fitting = F.concat(
        F.lit(r"(?s)[^ ](?:.{0,"), (budget - 2).cast("string"), F.lit(r"}[^ ])?(?= |\z)|[^ ]+")
    )
    pattern = F.when(budget > 1, fitting).otherwise(F.lit("[^ ]+"))
    odd = f"[{SPACE}&&[^ ]]"
    return F.when(plain.rlike(f" {odd}|{odd} "), _folded_pieces(sentence, budget)).otherwise(
        F.regexp_extract_all(plain, pattern, F.lit(0))
    )


def _folded_pieces(sentence: Column, budget: Column) -> Column:
    """Pieces word by word, for sentences with odd white space."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, word: Column) -> Column:
        wider = strip(F.concat(acc["cur"], F.lit(" "), word))
        full = (acc["cur"] != "") & (F.length(wider) > budget)
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), word.alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), wider.alias("cur")))

    return F.aggregate(
        F.split(sentence, " "),
        start,
        step,
        lambda acc: F.when(
            acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))
        ).otherwise(acc["done"]),
    )


def _tail(cur: Column, overlap: int) -> Column:
    """Last sentences that together reach `overlap` characters, and their joined length."""
    start = F.struct(F.array().cast("array<string>").alias("keep"), F.lit(0).alias("total"))

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(
            F.concat(F.array(s), acc["keep"]).alias("keep"),
            (acc["total"] + F.length(s) + 1).alias("total"),
        )
        return F.when(acc["total"] < overlap, more).otherwise(acc)

    return F.aggregate(F.reverse(cur), start, step)


#: Units that are walked before their chunks are handed on.
_STRIDE = 256


def chunk_units(text: Column, budget: Column) -> Column:
    """Sentences `(text, alone)` of a text; those longer than the budget in pieces that stand alone."""
    return F.flatten(
        F.transform(
            sentences(text),
            lambda s: F.when(
                F.length(s) > budget,
                F.transform(
                    _pieces(s, budget), lambda p: F.struct(p.alias("text"), F.lit(True).alias("alone"))
                ),
            ).otherwise(F.array(F.struct(s.alias("text"), F.lit(False).alias("alone")))),
        )
    )


def chunk_bodies(units: Column, budget: Column, overlap: int) -> Column:
    """Chunks of the units of a text: a fold over them.

    Sentences fill a chunk up to `budget` characters; the next chunk starts with the tail of
    the last one, which is not held against the budget.  Pieces of a sentence longer than
    the budget stand alone and carry no overlap on.  The fold goes in strides with a short list of
    finished chunks each, so no list is copied as often as a long text has chunks.
    """
    none = F.array().cast("array<string>")

    def state(done: Column, cur: Column, used: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), used.alias("used"))

    def closed(acc: Column) -> Column:
        return F.when(
            F.size(acc["cur"]) > 0,
            F.concat(acc["done"], F.array(F.array_join(acc["cur"], " "))),
        ).otherwise(acc["done"])

    def step(acc: Column, unit: Column) -> Column:
        one = F.array(unit["text"])
        size = F.length(unit["text"])
        started = F.size(acc["cur"]) > 0
        tail = _tail(acc["cur"], overlap)
        return (
            F.when(unit["alone"], state(F.concat(closed(acc), one), none, F.lit(0)))
            .when(
                started & (acc["used"] + 1 + size > budget),
                state(closed(acc), F.concat(tail["keep"], one), tail["total"] + size),
            )
            .when(started, state(acc["done"], F.concat(acc["cur"], one), acc["used"] + 1 + size))
            .otherwise(state(acc["done"], one, size))
        )

    def stride(acc: Column, begin: Column) -> Column:
        walked = F.aggregate(
            F.slice(units, begin, F.lit(_STRIDE)), state(none, acc["cur"], acc["used"]), step
        )
        # a link of its own, so that the inner fold runs once
        joined = F.transform(
            F.array(walked),
            lambda w: state(F.concat(acc["done"], F.array(w["done"])), w["cur"], w["used"]),
        )
        return F.element_at(joined, 1)

    begins = F.when(
        F.size(units) > 0, F.sequence(F.lit(1), F.size(units), F.lit(_STRIDE))
    ).otherwise(F.array().cast("array<int>"))
    lists = F.array().cast("array<array<string>>")
    return F.aggregate(
        begins,
        state(lists, none, F.lit(0)),
        stride,
        lambda acc: F.flatten(
            F.concat(
                acc["done"],
                F.array(F.when(F.size(acc["cur"]) > 0, F.array(F.array_join(acc["cur"], " "))).otherwise(none)),
            )
        ),
    )


def chunk_documents(
    df: DataFrame,
    id_col: str,
    text_col: str,
    chunk_chars: int = 900,
    overlap_chars: int = 150,
    title_col: str | None = None,
) -> DataFrame:
    """Rows `(id, chunk_index, content, char_len)`; a text without words has none.

    With `title_col` every chunk starts with the title line, and the body budget is what
    the title leaves of `chunk_chars`.  A narrow projection: nothing is shuffled.
    """
    title = F.lit(None).cast("string") if title_col is None else F.col(title_col)
    prefix = F.lit("") if title_col is None else F.concat(title, F.lit("\n"))
    budget = (
        F.lit(chunk_chars)
        if title_col is None
        else F.greatest(F.lit(chunk_chars) - F.length(prefix), F.lit(1))
    )
    units = chunk_units(F.col(text_col), F.col("_budget"))
    bodies = chunk_bodies(F.col("_units"), F.col("_budget"), overlap_chars)
    return (
        df.select(id_col, text_col, prefix.alias("_prefix"), budget.alias("_budget"))
        .where(F.col(text_col).isNotNull())
        # as rows of their own, the units are made once, however often they are looked at
        .select(id_col, "_prefix", "_budget", F.explode_outer(F.array(units)).alias("_units"))
        # outer: the plain form would add a size filter that cuts every text a second time
        .select(id_col, "_prefix", F.posexplode_outer(bodies).alias("chunk_index", "_body"))
        .where(F.col("chunk_index").isNotNull())
        .select(id_col, "chunk_index", F.concat("_prefix", "_body").alias("content"))
        .withColumn("char_len", F.length("content"))
    )
