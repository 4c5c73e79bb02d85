"""Word stems and stop words for searches: word forms of one stem find each other.

Stems come as a table of `(term, stem)`, one row per word form, stored beside the index.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words left out of a search text, by the published Snowball lists.
STOP_WORDS = frozenset(
    """
    и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне
    было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него
    до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы
    тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому
    этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех
    никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них
    какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой
    им более всегда конечно всю между
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own same
    so than too very s t can will just don should now
    """.split()
)


def stem_forms(vocabulary: DataFrame, words: Iterable[str]) -> dict[str, str]:
    """All forms of the stems of some words, each with its stem; a word that the vocabulary lacks
    is its own stem.  As many rows as the stems of a search have forms come to the driver."""
    asked = sorted(set(words))
    known = vocabulary.where(F.col("term").isin(*asked)).select("stem").distinct()
    rows = vocabulary.join(known, "stem", "left_semi").select("term", "stem").collect()
    return {w: w for w in asked} | {r["term"]: r["stem"] for r in rows}


def stem_index(
    index: DataFrame, vocabulary: DataFrame, forms: dict[str, str] | None = None
) -> DataFrame:
    """Index with stems in place of terms, for the searches of `fulltext`.

    With `forms` (see `stem_forms`) only their rows are read: the store sorted by term finds them
    by its statistics, and their stems are literals.  Without, the whole vocabulary is joined.
    """
    if forms is None:
        named = index.join(vocabulary, "term")
    else:
        pairs = [F.lit(x) for pair in forms.items() for x in pair]
        stem = F.element_at(F.create_map(*pairs), F.col("term"))
        named = index.where(F.col("term").isin(*forms)).withColumn("stem", stem)
    return named.select(F.col("stem").alias("term"), "posting_id", "field", "positions")
