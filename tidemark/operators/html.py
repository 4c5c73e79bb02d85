"""HTML to readable text over a column.

Tags and entities go through the standard library parser in one Arrow pass; the clean-up
of spaces and blank lines is done by native expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import SPACE, strip

# Tags that end a line; a list item also gets a marker.
LINE_TAGS = (
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table blockquote section hr"
).split()
ITEM_MARK = "\n— "

#: White space other than the line feed.
_INLINE = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]"


class _Reader(HTMLParser):
    """Collects character data, with a line break at each line tag.

    Comments and declarations yield nothing; the content of script and style is data.
    """

    opening = dict.fromkeys(LINE_TAGS, "\n") | {"li": ITEM_MARK}

    def __init__(self, markup: str) -> None:
        super().__init__()
        self.pieces: list[str] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.pieces.append(self.opening.get(tag, ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.opening:
            self.pieces.append("\n")

    def handle_data(self, data):
        self.pieces.append(data)


#: Bytes of markup, or rows, that are Python strings at a time, whatever the size of an Arrow batch.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of an array of texts of SLICE_ROWS rows at most, and of SLICE_BYTES but for one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))
        stop = min(max(stop, start + 1), start + SLICE_ROWS, len(texts))
        yield texts.slice(start, stop - start)
        start = stop


@F.arrow_udf(T.StringType())
def _plain(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # the second unescape resolves entities that were escaped twice
    for markup in parts:
        for some in slices(markup):
            read = (None if m is None else unescape("".join(_Reader(m).pieces)) for m in some.to_pylist())
            yield pa.array(list(read), pa.string())


def tidy(text: Column) -> Column:
    """Single spaces, trimmed lines, at most one blank line in a row."""
    spaced = F.regexp_replace(F.translate(text, "\xa0", " "), r"[ \t]+", " ")
    lines = F.regexp_replace(spaced, rf"{_INLINE}*\n{_INLINE}*", "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def html_text(html: Column) -> Column:
    """Readable text of an HTML column; empty for null and blank."""
    blank = html.isNull() | html.rlike(rf"^{SPACE}*$")
    return F.when(blank, F.lit("")).otherwise(tidy(_plain(html)))


def extract_text(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Rows with the readable text of `html`, at the parallelism of the input.

    A single unsplittable file should be repartitioned by the caller first.
    """
    return df.withColumn("_plain", _plain(F.coalesce(html, F.lit("")))).withColumn(
        text, tidy(F.col("_plain"))
    ).drop("_plain")
