"""Byte-level BPE: a sentencepiece model written straight from a vocabulary of ranks."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import annotated, text_udf

#: Bytes of chunks and their ids that a task remembers before it starts anew.
CACHE = 16_000_000
#: What an entry takes beside its characters and ids, about.
ENTRY = 200

#: A single space between two visible characters always begins the next pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]


def _chunks(text: str) -> list[str]:
    """A text cut where a pre-token begins for certain; the parts make up the text."""
    joined = any(w in text and (w + " " in text or " " + w in text) for w in _WHITE)
    if joined or text[:1] == " " or text[-1:] == " ":
        head, *rest = _CUT.split(text)
    else:
        head, *rest = text.split(" ")
    return [head, *[" " + r for r in rest]]


def byte_letters() -> list[str]:
    """A visible character for each byte: itself if it is visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def model_bytes(tokens: list[bytes], ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece i is `tokens[i]` in byte letters, scored by its negative
    rank; the unknown piece comes last.  Normalisation is the identity."""
    letters = dict(enumerate(byte_letters()))
    score = 0x15  # field 2, four bytes
    out = []
    for t in tokens:
        piece = t.decode("latin-1").translate(letters).encode()
        out.append(_message(1, _message(1, piece) + struct.pack("<Bf", score, -ranks[t])))
    out.append(_message(1, _message(1, b"<unk>") + struct.pack("<Bf", score, 0.0) + b"\x18\x02"))
    trainer = b"\x18\x02"  # the model type is BPE
    plain = _message(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"  # no prefix, no squeezing
    return b"".join([*out, _message(2, trainer), _message(3, plain)])


class Inverse:
    """Inverse mapping: the bytes of each id; of an id without token, nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Codec:
    """Encodes and decodes with the ranks of a file.  Ids are bytes of unsigned 32-bit
    little-endian integers."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokens = sorted(ranks, key=ranks.get)
        self.letters = dict(enumerate(byte_letters()))
        self.ids = {t: struct.pack("<I", ranks[t]) for t in self.tokens}
        self.rank_of = np.array([ranks[t] for t in self.tokens], "<u4")
        self.model = sentencepiece.SentencePieceProcessor(
            model_proto=model_bytes(self.tokens, ranks)
        )
        self.pattern = regex.compile(pattern)
        self.inverse = Inverse(ranks)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, fresh: list[str]) -> None:
        """Encode new chunks: each pre-token by the model, unless it is a token itself."""
        # ASCII letters after a space are one pre-token, without asking the pattern
        parts = [
            [c] if c.isascii() and c[1:].isalpha() and c[0] == " " else self.pattern.findall(c)
            for c in fresh
        ]
        found, rest = {}, []
        for p in dict.fromkeys(p for row in parts for p in row):
            spelled = p.encode()
            known = self.ids.get(spelled)
            if known is None:
                rest.append((p, spelled.decode("latin-1").translate(self.letters)))
            else:
                found[p] = known
        pieces = self.model.encode([x for _, x in rest], num_threads=1)
        sizes = np.cumsum([0, *map(len, pieces)]).tolist()
        flat = np.fromiter((i for row in pieces for i in row), np.int64, sizes[-1])
        ids = self.rank_of[flat].tobytes()
        for (p, _), begin, end in zip(rest, sizes, sizes[1:]):
            found[p] = ids[4 * begin : 4 * end]
        for c, row in zip(fresh, parts):
            self.known[c] = found[row[0]] if len(row) == 1 else b"".join([found[p] for p in row])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        cut = [_chunks(t or "") for t in texts]
        wanted = set().union(*cut)
        fresh = wanted.difference(self.known)
        more = sum(map(len, fresh)) * 5 + len(fresh) * ENTRY
        if self.held + more > CACHE:
            self.known.clear()
            self.held, fresh = 0, wanted
            more = sum(map(len, fresh)) * 5 + len(fresh) * ENTRY
        self.held += more
        self._learn(sorted(fresh))
        get = self.known.__getitem__
        return [b"".join(map(get, row)) for row in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return self.inverse.decode(ids)


def encode(text, path: str, pattern: str = public_tokenizers.PATTERN):
    """The ids of a text column as bytes of little-endian unsigned 32-bit integers: what the rank
    vocabulary of `path` gives for each match of `pattern` by itself, no special tokens.  A null
    or empty text has no ids.  `path` is read on the executors."""

    def work():
        codec = Codec(path, pattern)
        return lambda texts: pa.array(codec.encode(texts.to_pylist()), pa.binary())

    return text_udf(work, "binary")(text)


def decode(ids, path: str):
    """The bytes that a column of ids stands for; null gives null.  An id past the vocabulary is an
    error, an unused one in it gives nothing."""

    def decoder(batches):
        inverse = Inverse(read_ranks(path))
        for batch in batches:
            yield pa.array(
                [None if x is None else inverse.decode(x) for x in batch.to_pylist()], pa.binary()
            )

    decoder.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decoder, "binary").asNondeterministic()(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(row, ids, decoded): each document with its ids and the bytes they decode to."""
    coded = annotated(docs, encode(F.col(text), path))
    return coded.select("row", F.col("out").alias("ids"), decode(F.col("out"), path).alias("decoded"))


_DIGESTS = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.  Texts are encoded and their ids
    decoded in one pass by one worker a task, and only digests come back."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work():
        codec = Codec(path, public_tokenizers.PATTERN)

        def step(texts: pa.Array) -> pa.Array:
            coded = codec.encode(texts.to_pylist())
            columns = [
                pa.array([len(ids) // 4 for ids in coded], pa.int64()),
                pa.array([sha256(ids).hexdigest() for ids in coded], pa.string()),
                pa.array([sha256(codec.decode(ids)).hexdigest() for ids in coded], pa.string()),
            ]
            return pa.StructArray.from_arrays(
                columns, names=["n_tokens", "ids_sha256", "decoded_sha256"]
            )

        return step

    coded = annotated(docs.select("doc_id", "text"), text_udf(work, _DIGESTS)(F.col("text")))
    return coded.select("row.doc_id", "out.n_tokens", "out.ids_sha256", "out.decoded_sha256")


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
