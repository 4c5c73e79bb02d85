from __future__ import annotations

import gzip
import hashlib
import io

import pytest
from tidemark.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, folder, schema=PAGES, **options):
    pages = spark.createDataFrame(rows, schema).repartition(2)
    return warc.read_archives(warc.write_archives(pages, f"file://{folder}", **options)).collect()


def test_round_trip(spark, tmp_path):
    big, other = "é" * 700, "x" * 1000
    rows = [
        (1, "http://a/ b\n", big), (5, None, big), (3, "http://c", big), (2, "u", other),
        (4, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", ""), (5, None, big),
        (None, "n", big), (9, "u", "line\r\n\r\nWARC/1.1\r\n\x00"), (10, "u", "y" * 400_000),
    ]
    got = round_trip(spark, rows, tmp_path, archive_bytes=900)
    assert len(got) == len(rows)
    for r in got:
        texts = [(h or "").encode() for i, _, h in rows if i == r.page_id]
        assert r.payload_bytes == len(texts[0])
        assert r.payload_digest == hashlib.sha1(texts[0]).hexdigest()
        later = texts[0] == big.encode() and r.page_id != 5
        assert (r.record_type, r.refers_to) == (("revisit", 5) if later else ("response", None))
        assert r.payload is None if later else bytes(r.payload) == texts[0]
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%20b%0A"}
    files = list(tmp_path.glob("*.warc.gz"))
    assert len(files) > 2  # a new archive once one is full
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)


def test_hot_payload_takes_the_broadcast_way(spark, tmp_path):
    rows = [(i, "u", "h" * 1000 if i % 3 else f"{i:01000d}") for i in range(3600)]
    got = round_trip(spark, rows, tmp_path)
    assert sum(r.refers_to == 3599 for r in got) == 2399
    assert sum(r.record_type == "response" for r in got) == 1201


def test_empty_table_and_clashing_names(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a")).count() == 0
    more = spark.createDataFrame(
        [(1, "u", "t", "x", 3)], PAGES + ", digest string, refers_to int"
    )
    assert warc.read_archives(warc.write_archives(more, f"file://{tmp_path}/b")).count() == 1


def test_damage_is_found():
    good = warc.record(1, "u", b"payload", False, None, "2024-01-01T00:00:00Z")
    two = good + warc.record(2, "u", b"other", True, 1, "2024-01-01T00:00:00Z")
    read = lambda raw: [warc.parse(d) for _, d in warc.members(io.BytesIO(raw))]
    assert [r["page_id"] for r in read(two)] == [1, 2] and read(two)[1]["refers_to"] == 1
    assert [at for at, _ in warc.members(io.BytesIO(two))] == [0, len(good)]
    assert read(b"") == []
    with pytest.raises(ValueError, match="cut off"):
        read(two[:-3])
    with pytest.raises(ValueError, match="bad gzip"):
        read(good + b"junk")
    plain = gzip.decompress(good)
    for a, b in ((b"payload", b"pAyload"), (b"Content-Length: ", b"Content-Length: 1"), (b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(ValueError):
            warc.parse(plain.replace(a, b))


def test_members_across_chunks(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 3)
    raw = b"".join(warc.record(i, None, b"p" * i, False, None, "d") for i in range(9))
    got = [warc.parse(d) for _, d in warc.members(io.BytesIO(raw))]
    assert [(r["page_id"], r["payload_bytes"], r["url"]) for r in got] == [(i, i, None) for i in range(9)]


def test_query_reads_all_pages(spark, small):
    got = {r.page_id: r for r in warc.op6(spark, "/root/testdata/sf0.001").collect()}
    pages = small("pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        data = (p.html or "").encode()
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
