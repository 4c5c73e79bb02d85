"""Letters of texts as vectors; a module of its own, so that its workers import little."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.html import slices

LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: The letter 1 to 26 of a byte, 0 for any other; no byte of a longer character is one of a letter.
_LETTER_OF = np.zeros(256, np.uint8)
for _i, _x in enumerate(LETTERS, 1):
    _LETTER_OF[[ord(_x), ord(_x.upper())]] = _i


def _letter_rows(texts: pa.Array) -> pa.Array:
    raw = texts.cast(pa.large_binary())
    size = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)
    data = b"".join(raw.drop_null().to_pylist())
    letter = _LETTER_OF[np.frombuffer(data, np.uint8)]
    wide = len(LETTERS) + 1
    row = np.repeat(np.arange(len(texts)) * wide, size)
    counts = np.bincount(row + letter, minlength=len(texts) * wide).reshape(-1, wide)[:, 1:]
    some = counts.any(axis=1)
    starts = np.concatenate([[0], np.cumsum(some) * len(LETTERS)]).astype(np.int32)
    flat = pa.array(counts[some].astype(np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(starts), flat, mask=pa.array(~some))


def _counted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        yield pa.concat_arrays([_letter_rows(some) for some in slices(texts)] or [_letter_rows(texts)])


def letter_counts(text: Column) -> Column:
    """How often each letter a to z stands in a text, either case: vectors that SQL can make too.
    A text without any has none."""
    # as if by chance, so that a condition on the vector does not count the letters once more
    return F.arrow_udf(_counted, T.ArrayType(T.DoubleType())).asNondeterministic()(text)
