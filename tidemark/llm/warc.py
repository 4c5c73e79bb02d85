"""WARC archives: written a gzip member per record, read back one after the other."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, shared_folder, stored

#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 64_000_000
#: Bytes read at once.
CHUNK = 65_536

_PAGE = "urn:tidemark:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"

RECORD = (
    "page_id:bigint,url:string,payload_bytes:bigint,payload_digest:string,record_type:string,"
    "refers_to:bigint,archive:string,position:bigint,payload:binary"
)
_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("archive", pa.string()),
        ("position", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{_PAGE}{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    if not name.startswith(f"<{_PAGE}") or not name.endswith(">"):
        raise ValueError(f"not the name of a page: {name[:80]}")
    number = name[len(_PAGE) + 1 : -1]
    return int(number) if number else None


def record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    revisit: bool,
    refers_to: int | None,
    date: str,
) -> bytes:
    """A record as a gzip member.  A revisit has the HTTP head only, which tells the length of the
    payload; control characters and spaces of a URL are percent-encoded."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    head += [f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    text = "\r\n".join(head).encode() + _END
    return packed.compress(text + block + _END) + packed.flush()


def members(stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """The gzip members of a stream with their positions, decompressed as they are read."""
    begin = at = 0
    unpack, out, data = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not data:
            data = stream.read(CHUNK)
            if not data:
                break
        try:
            out += unpack.decompress(data)
        except zlib.error as e:
            raise ValueError(f"bad gzip member at {begin}: {e}") from e
        at += len(data) - len(unpack.unused_data)
        data = unpack.unused_data
        if unpack.eof:
            yield begin, bytes(out)
            begin, unpack, out = at, zlib.decompressobj(31), bytearray()
    if at != begin:
        raise ValueError(f"the gzip member at {begin} is cut off")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    pairs = (x.partition(":") for x in lines)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes) -> dict:
    """A record of the kind that `record` writes.  The block is as long as its content length says;
    lengths and digests are verified, and a record that fails is an error."""
    head, found, rest = data.partition(_END)
    version, fields = _fields(head)
    if not found or not version.startswith("WARC/1."):
        raise ValueError("no WARC head")
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != _END:
        raise ValueError(f"content length {size} does not frame the block")
    if _sha1(block) != fields["warc-block-digest"]:
        raise ValueError("the block's digest differs")
    http, _, payload = block.partition(_END)
    length = int(_fields(http)[1]["content-length"])
    digest, kind = fields["warc-payload-digest"], fields["warc-type"]
    if kind == "response" and (len(payload) != length or _sha1(payload) != digest):
        raise ValueError("the payload's length or digest differs")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": length,
        "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
        "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def duplicates(pages: DataFrame, page_id: str, html: str, least: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of at least `least` bytes is that
    of a page with a larger id too.  Only ids and digests are moved."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("size"),
    )
    narrow = stored(narrow.where(F.col("size") >= least).drop("size"), "payloads")
    groups = (
        narrow.groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
        .where(F.col("n") > 1)
    )
    groups = stored(groups, "equal-payloads")
    return (
        join_hot(narrow, groups.drop("n"), "digest", groups.select("digest", "n"))
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = 1000,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page into gzipped WARC files below `folder`; returns the stored list
    (archive, records, bytes) of what was written.

    Of pages with equal payloads of at least `least` bytes, the one with the largest id is a
    response and the others revisit it; others are responses.  Null html is an empty payload;
    repeated rows of the largest id are all responses; a null id counts as smaller than any.  `folder` is a URI that
    pyarrow can open on every executor.  A retried task writes files of its own, and the list
    names those of the attempt that ended, so lost executors leave at most files nobody reads.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    later = duplicates(pages, page_id, html, least).select(
        F.col("page_id").alias("_id"), "digest", "refers_to", F.lit(True).alias("revisit")
    )
    wide = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
    )
    both = wide.join(
        later,
        F.col("page_id").eqNullSafe(F.col("_id"))
        & (F.sha1(F.col("payload").cast("binary")) == F.col("digest")),
        "left",
    ).select("page_id", "url", "payload", F.coalesce("revisit", F.lit(False)), "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, path = fs.FileSystem.from_uri(folder)
        target.create_dir(path, recursive=True)
        out, name, records, size = None, "", 0, 0

        def done():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [f"{folder}/{name}"], "records": [records], "bytes": [size]}
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = target.open_output_stream(f"{path}/{name}", compression=None)
                packed = record(row[0], row[1], row[2].encode(), row[3], row[4], date)
                out.write(packed)
                records, size = records + 1, size + len(packed)
                if size >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(both.mapInArrow(write, "archive string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of the archives listed in `archives`, each read by one task in order.
    Digests are always verified; without `payloads` that column stays null."""
    n = max(1, archives.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for position, data in members(stream):
                        try:
                            row = parse(data)
                        except (ValueError, KeyError) as e:
                            raise ValueError(f"{archive} at {position}: {e!r}") from e
                        row |= {"archive": archive, "position": position}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) == 1000 or size > 16_000_000:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return archives.select("archive").repartition(n).mapInArrow(read, RECORD.replace(":", " "))


def op6(spark, sf_dir: str) -> DataFrame:
    """Every page's record after a round trip through WARC files in the shared folder."""
    folder = shared_folder(spark)
    folder = folder if ":" in folder else f"file://{folder}"
    written = write_archives(
        spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/warc-{uuid.uuid4().hex}"
    )
    return read_archives(written, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size
  FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id < top THEN top END AS refers_to
FROM w
"""
