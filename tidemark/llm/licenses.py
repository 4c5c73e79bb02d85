"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotated, text_udf, words_of

#: Short notices and the opening or whole text of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in"
        " all copies or substantial portions of the Software.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies.",
    ),
    ("proprietary", "All rights reserved."),
]

FOUND = "array<struct<license:string,coverage:double,first_word:int,last_word:int>>"
_FOUND = pa.struct(
    [
        ("license", pa.string()),
        ("coverage", pa.float64()),
        ("first_word", pa.int32()),
        ("last_word", pa.int32()),
    ]
)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, in order of the first, whose second rises."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(ends, y)
        before[i] = last[k - 1] if k else -1
        if k == len(ends):
            ends.append(y)
            last.append(i)
        else:
            ends[k], last[k] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of two word lists: words that occur once in both are anchors, the longest
    rising run of them is kept, and the gaps between are aligned in the same way.  Equal words at
    the two ends of a gap are aligned as well."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising(
            [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        )
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(found)


class Templates:
    """Templates as numbers of the words that any of them has."""

    def __init__(self, templates: list[tuple[str, str]]):
        words = words_of(pa.array([t for _, t in templates], pa.string()))
        cut = [words.codes[a:b].tolist() for a, b in zip(words.bounds, words.bounds[1:])]
        self.names = [n for n, _ in templates]
        self.vocabulary, self.words = words.vocabulary, cut
        self.times = np.zeros((len(words.vocabulary), len(cut)))
        for t, row in enumerate(cut):
            np.add.at(self.times, (row, t), 1)
        self.size = np.maximum(self.times.sum(axis=0), 1)


def best_match(words: np.ndarray, places: np.ndarray, template: list[int], least: float):
    """The best covered stretch of a text: (coverage, first, last) or None.

    `places` are the places of the template's words in the text.  Stretches without a gap of over
    the template's length are cut into windows twice as long as the template, and each window that
    has enough of its words is aligned.
    """
    n, best = len(template), None
    wanted = Counter(template)
    cuts = np.flatnonzero(np.diff(places) > n) + 1
    for run in np.split(places, cuts):
        if len(run) < least * n:
            continue
        begin, stop = int(run[0]), int(run[-1]) + 1
        step = max(1, n // 2)
        for at in range(begin, max(begin + 1, stop - 2 * n + step), step):
            window = words[at : min(at + 2 * n, stop)].tolist()
            have = Counter(w for w in window if w in wanted)
            if sum(min(k, have[w]) for w, k in wanted.items()) < least * n:
                continue
            pairs = align(window, template)
            if len(pairs) >= least * n and (best is None or len(pairs) / n > best[0]):
                best = len(pairs) / n, at + pairs[0][0], at + pairs[-1][0]
    return best


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] | None = None,
    text: str = "text",
    least: float = 0.8,
) -> DataFrame:
    """(row, out): each document with FOUND, one entry for each license of which a template is
    covered by at least `least` of its words in order within a stretch of twice its length: the
    best coverage, then the first place, and the first and last word of it.

    Templates (license, text) are parameters, held in every task.  A text that lacks the words is
    not aligned: no alignment could reach `least`.  Null and empty texts have no licenses; a
    template without words is never found; several templates of a license count as one.
    """
    given = [t for t in (templates or TEMPLATES) if t[1]]

    def work():
        known = Templates(given)

        def step(texts):
            words = words_of(texts)
            n = len(texts)
            code = pc.index_in(words.vocabulary, value_set=known.vocabulary)
            code = code.fill_null(-1).to_numpy().astype(np.int64)
            text_words = code[words.codes] if len(words.codes) else np.empty(0, np.int64)
            owner = np.repeat(np.arange(n), np.diff(words.bounds))
            hit = text_words >= 0
            width = len(known.vocabulary)
            has = np.zeros((n, width), bool)
            has[owner[hit], text_words[hit]] = True
            # the most that the words of a text could cover of each template
            can = (has @ known.times) / known.size >= least
            out: list[list[dict]] = [[] for _ in range(n)]
            for d in np.flatnonzero(can.any(axis=1)):
                own = text_words[words.bounds[d] : words.bounds[d + 1]]
                best: dict[str, tuple] = {}
                for t in np.flatnonzero(can[d]):
                    places = np.flatnonzero(np.isin(own, known.words[t]))
                    match = best_match(own, places, known.words[t], least) if known.words[t] else None
                    name = known.names[t]
                    if match and (name not in best or match[0] > best[name][0]):
                        best[name] = match
                out[d] = [
                    {"license": k, "coverage": v[0], "first_word": v[1], "last_word": v[2]}
                    for k, v in sorted(best.items())
                ]
            return pa.array(out, pa.list_(_FOUND))

        return step

    return annotated(docs, text_udf(work, FOUND)(F.col(text)))


def op9(spark, sf_dir: str) -> DataFrame:
    """The licenses that every document names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    best = F.array_max(
        F.transform("out", lambda m: F.struct(m["coverage"], m["license"]))
    )
    return scan(docs).select(
        "row.doc_id",
        F.size("out").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("out", lambda m: m["license"]), ",").alias("licenses"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
    )
