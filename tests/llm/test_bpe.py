from __future__ import annotations

import base64
import hashlib
import re
import sys

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
HARD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "it's  we'll 'S", "tab\tx \ty", "x y z",
    "日本語 テスト 123 4567", "é ‍👩‍👩‍👧", "a \x1c b\x1f c\x85d", "\x00\x01 \x7f", "<|endoftext|>",
    "aaaa" * 3000, "ab" * 5000 + " " * 700 + "z", "word.\nNext  line\r\n\r\n end", "… — ­soft",
    " x 　y", "ﬁ ŀ ß ẞ", "don't'ts", "' s 's", "۱۲۳ ½ ²",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def standard():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(codec, standard, texts):
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == standard.encode_ordinary(t or "")
        assert codec.decode(ids) == (t or "").encode()


def test_equals_the_standard_library(codec, standard, small):
    check(codec, standard, HARD)
    for name in ("documents", "benchmark", "conversations"):
        check(codec, standard, [r.text for r in small(name).select("text").collect()])
    check(codec, standard, [r.html for r in small("pages").select("html").collect()])


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80), glue=st.sampled_from([" ", "", "\n ", "  "]))
def test_any_text_equals_the_standard_library(codec, standard, text, glue):
    check(codec, standard, [text, text + glue + text])


def test_every_token_and_every_byte(codec, standard):
    for t in codec.tokens[::37]:
        assert codec.decode(codec.ids[t]) == t
    spelled = [codec.letters[b] for b in range(256)]
    assert len(set(spelled)) == 256
    pieces = codec.model.encode(spelled, num_threads=1)
    assert [codec.tokens[p[0]] for p in pieces] == [bytes([b]) for b in range(256)]


def test_cuts_only_where_the_pattern_does():
    pattern, white = regex.compile(r"\s"), re.compile(r"\s")
    for c in map(chr, range(sys.maxunicode + 1)):
        assert white.match(c) or not pattern.match(c)


def test_memory_is_bounded(codec, standard, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    own = bpe.Codec(PATH, P.PATTERN)
    check(own, standard, ["one two three four five six seven", "eight one two", "nine ten one"] * 3)
    assert len(own.known) < 20


def test_columns_and_query(spark, make_docs):
    docs = make_docs([(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, "ß")])
    docs = docs.withColumnRenamed("source", "row").withColumnRenamed("lang", "ids")
    out = bpe.encode_documents(docs, PATH).collect()
    by = {r.row.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in out}
    assert by[2] == by[3] == (b"", b"") and by[1][1] == b"Hello world" and len(out) == 5
    rows = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert rows[2].n_tokens == 0 and rows[1].n_tokens == 2
    assert rows[1].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert rows[1].ids_sha256 == hashlib.sha256(by[1][0]).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0


def test_white_space_is_listed_whole():
    white = re.compile(r"\s")
    assert {c for c in map(chr, range(sys.maxunicode + 1)) if white.match(c)} == set(bpe._WHITE)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("ab .\n\t  \x1f　é1"), max_size=30))
def test_chunks_make_up_the_text(codec, standard, text):
    assert "".join(bpe._chunks(text)) == text
    check(codec, standard, [text])
