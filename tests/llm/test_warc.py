import gzip
import hashlib

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tamis.llm import warc


@given(st.binary(max_size=200), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"5\r\nab", b"zz\r\n", b"2\r\nabX\r\n0\r\n\r\n"])
def test_broken_chunks(body):
    with pytest.raises(ValueError):
        warc.dechunked(body)


def test_extensions_and_trailers():
    assert warc.dechunked(b"2;x=1\r\nab\r\n0\r\nA: b\r\n\r\n") == b"ab"


@given(st.binary(max_size=300), st.integers(60, 200))
def test_records_parse_back(payload, segment):
    data = b"".join(r + b"\r\n\r\n" for r in warc.page_records(0, 5, "http://a/ü b", payload, None, segment, 37))
    found = list(warc.parse(data))
    block = b"".join(b for _, b in found)
    assert warc.dechunked(block.partition(b"\r\n\r\n")[2]) == payload
    if len(found) > 1:
        assert int(found[-1][0]["warc-segment-total-length"]) == len(block)
        assert [int(h["warc-segment-number"]) for h, _ in found] == list(range(1, len(found) + 1))


def test_pages(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 3000, 0), (2, "http://a/", "x" * 3000, 0), (2, "http://a/", "x" * 3000, 0), (3, None, None, 0), (4, "u", "é" * 9000, 0), (None, "u", "x" * 3000, 0), (5, "u", "short", 0), (6, "u", "short", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type int")
    warc.write(pages, f"file://{tmp_path}/a", segment_bytes=700, chunk_bytes=333)
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(r.type, r.refers_to, r.payload_bytes) for r in by[1]] == [("revisit", 2, 3000)]
    assert [r.type for r in by[2]] == ["response"] * 2 and by[None][0].type == "response"
    assert by[4][0].payload == ("é" * 9000).encode() and by[3][0].payload_bytes == 0
    assert all(r.payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for i, _, h, _ in rows for r in by[i])
    warc.write(pages.limit(0), f"file://{tmp_path}/b")
    warc.write(pages, f"file://{tmp_path}/c", segment_bytes=700, chunk_bytes=333, records_per_file=2)
    assert all(len(list(warc.parse(gzip.decompress(f.read_bytes())))) <= 2 for f in (tmp_path / "c").glob("*.gz"))
    key = lambda r: (str(r.page_id), r.payload_digest, r.type, str(r.refers_to))
    assert sorted(map(key, warc.read(spark, f"file://{tmp_path}/c").collect())) == sorted(map(key, got))
    assert warc.read(spark, f"file://{tmp_path}/b").count() == 0


def test_segments_over_files_missing_and_short(spark, tmp_path):
    make = lambda i: warc.page_records(0, i, "u", b"y" * 1000, None, 300, 256)
    whole, torn, short = make(1), make(2), make(3)
    parts = [whole[0], whole[2], torn[0], *short[:-1]], [whole[1], *whole[3:], torn[2], whole[1]], [*torn[3:], short[-1].replace(b"Total-Length: ", b"Total-Length: 9")]
    for i, records in enumerate(parts):
        data = b"".join(r + b"\r\n\r\n" for r in records)
        (tmp_path / f"{i}.warc").write_bytes(gzip.compress(data) if i else data)
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got[1].payload == b"y" * 1000 and got[1].error is None
    assert got[2].payload is None and "missing" in got[2].error
    assert got[3].payload is None and "total length" in got[3].error


def test_sql_gives_the_same(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.op4_warc_segments(spark, small).select(*columns).collect()
    want = con.sql(f"select {', '.join(columns)} from ({warc.OP4_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_archives_of_others(spark, tmp_path):
    import base64
    import gzip
    import hashlib

    body = b"<p>text"
    sha = hashlib.sha1(body).digest()
    record = lambda kind, block, *more: warc._record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}>"), *more], block)
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(body, 3)
    records = [record("warcinfo", b"software: x\r\n\r\n"), record("response", http, ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode())), record("resource", body, ("WARC-Payload-Digest", f"sha1:{sha.hex().upper()}"))]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))  # each record is a member of its own
    got = {r.type: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert all(r.error is None for r in got.values())
    assert got["response"].payload == body == got["resource"].payload and got["warcinfo"].payload == b"software: x\r\n\r\n"
