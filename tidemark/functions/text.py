"""Text column rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One whitespace character in the Unicode sense (Java's \s alone is ASCII).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: One word: letters, digits and underscore of any script.
WORD = r"[\p{L}\p{N}_]+"

# Punctuation dropped at both ends of a skill name.  Plus and hash signs
# are not in it, so "C++" and "C#" keep theirs.
EDGE_PUNCTUATION = r"""[\s\p{Z}\-–—•·,.;:/\\()\[\]{}"'«»]"""


def strip(col: Column) -> Column:
    """Trim Unicode whitespace at both ends (`trim` removes U+0020 only)."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, f"{SPACE}+$", "")


def fold_case(col: Column) -> Column:
    """Caseless form: lower case plus the two foldings that differ from it in practice."""
    return F.translate(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), "ς", "σ")


def fold_yo(col: Column) -> Column:
    return F.translate(col, "ё", "е")


def norm_name(col: Column) -> Column:
    """Normal form of a skill name, used as its key everywhere."""
    bare = F.regexp_replace(col, f"^{EDGE_PUNCTUATION}+|{EDGE_PUNCTUATION}+$", "")
    return strip(fold_yo(fold_case(F.regexp_replace(bare, f"{SPACE}+", " "))))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once a row, however often `use` looks at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ordered_dedupe(names: Column) -> Column:
    """Trimmed names without blanks; of equal spellings (caseless, yo folded) the first stays."""
    clean = F.filter(F.transform(names, strip), lambda x: x.isNotNull() & (x != ""))

    def firsts(names: Column, keys: Column) -> Column:
        return F.filter(names, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)

    first = _once(
        clean, lambda c: _once(F.transform(c, lambda x: fold_yo(fold_case(x))), lambda k: firsts(c, k))
    )
    return F.coalesce(first, F.array().cast("array<string>"))


def snippet(col: Column, size: int = 400) -> Column:
    """Trimmed text, cut to `size` characters with an ellipsis when longer."""
    text = strip(col)
    return F.when(F.length(text) <= size, text).otherwise(
        F.concat(rstrip(F.substring(text, 1, size)), F.lit("…"))
    )


def truncate(col: Column, size: int = 400) -> Column:
    """Like `snippet`, but the head of the text is kept as it is."""
    return F.when(F.length(col) <= size, col).otherwise(
        F.concat(rstrip(F.substring(col, 1, size)), F.lit("…"))
    )


def words(col: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def contains_any(haystack: Column, needles: Sequence[str]) -> Column:
    """Array of the needles found in the text, caseless, in their given order."""
    if not needles:
        return F.array().cast("array<string>")
    low = F.lower(haystack)
    found = [F.when(F.contains(low, F.lit(n.strip().lower())), F.lit(n)) for n in needles]
    return F.array_compact(F.array(*found))
