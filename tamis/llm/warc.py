"""WARC archives: writing pages as segmented records, and reassembling them.

A page becomes a ``response`` record whose block is an HTTP response in chunked transfer
framing, or a ``revisit`` record where a later page has the same payload.  A block over
``segment_bytes`` is cut: the first record has segment number 1, ``continuation`` records
follow with their origin's identifier, and the last one tells the total length.  A reader
groups records by origin identifier, orders them by segment number, verifies numbers and
total length, and decodes the chunks.

Archives are written and read by Spark's own file sources, so any store that Spark reaches
will do: a record ends with two line ends, which is the text writer's line separator.

Scale: what is shuffled to find equal payloads is a digest and a number for each page.
Payloads are joined with the few digests that repeat (broadcast when the written table is
small, a join that adaptive execution can split otherwise).  When read back, the segments
that a file holds completely are put together there, and only the others are shuffled,
grouped by origin; a group is one record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm._common import arrow_map, scratch, table, written

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Payloads under this length are never revisits.
REVISIT_BYTES = 1000
#: Records in a file, at most, and so a file's bytes: no record's block is longer than a segment. A reader holds a file in memory.
RECORDS_PER_FILE = 8192
#: Types of records whose block is an HTTP message; the block of others is the payload.
HTTP = ("response", "revisit", "request")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, page_id long, uri string, type string, digest string, refers_to long, origin string, segment long, total long, block binary, error string"
KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over. ValueError if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size line")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        if n < 0 or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in [*fields, ("Content-Length", len(block))]), b"", b""]
    return b"\r\n".join(lines) + block


def page_records(number: int, page_id: int | None, uri: str | None, payload: bytes, target: int | None, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    """The records of one page, without the line ends after each. ``number`` tells rows with equal page_id apart."""
    sha = hashlib.sha1(payload).hexdigest()
    name = lambda k: f"<urn:uuid:{hashlib.md5(f'{page_id} {number} {k}'.encode()).hexdigest()}>"
    where = "".join(c if "!" <= c <= "~" and c not in "<>" else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in uri) if uri else None
    common = [("WARC-Date", DATE), *([("WARC-Target-URI", where)] if where else []), *([("X-Page-ID", page_id)] if page_id is not None else [])]
    if target is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name(1)), *common, ("WARC-Profile", PROFILE), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Refers-To-Page-ID", target), ("Content-Type", "application/http;msgtype=response")]
        return [_record(fields, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name(1)), *common, ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name(1)), ("WARC-Segment-Number", k), *last], part))
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if data[at : at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if len(data) < end + 4 + n:
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def _hex(told: str) -> str | None:
    """A SHA-1 digest in hexadecimal, of one in hexadecimal or, as is usual, base32; None for others."""
    kind, _, value = told.rpartition(":")
    if kind.lower() not in ("", "sha1"):
        return None
    if len(value) == 32:
        try:
            return base64.b32decode(value.upper()).hex()
        except ValueError:
            return None
    return value.lower() or None


def _number(headers: dict[str, str], name: str) -> int | None:
    return int(headers[name]) if name in headers else None


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes all rows of ``pages`` (page_id, url, html) as gzipped archives under ``path``.

    A null html is an empty payload. Of the rows with one payload of ``REVISIT_BYTES`` or
    more, those with the largest page_id are responses (repeated rows and all); the others
    revisit it. A row with a null page_id is a response. Other columns are ignored; an
    empty table writes no record. A page's segments may stand in two files.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    narrow = keyed.where(F.col("bytes") >= REVISIT_BYTES).select("digest", "page_id")
    repeated = written(narrow.groupBy("digest").agg(F.max("page_id").alias("target"), F.min("page_id").alias("least")).where("target > least").select("digest", "target"), "digests")
    marked = keyed.join(repeated, "digest", "left") if not repeated.isEmpty() else keyed.withColumn("target", F.lit(None).cast("long"))
    source = marked.select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("target"), F.col("target")).alias("target"), F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records: list[bytes] = []
            for number, page_id, url, payload, target in zip(*(b.column(k) for k in (4, 0, 1, 2, 3)), strict=True):
                records += page_records(number.as_py(), page_id.as_py(), url.as_py(), payload.as_py(), target.as_py(), segment_bytes, chunk_bytes)
                if len(records) >= RECORDS_PER_FILE:
                    yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])
                    records = []
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    arrow_map(source, run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _assembled(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of segments (number, total length, bytes), or None while some are missing."""
    segments = sorted(segments, key=lambda s: s[0])
    total = next((t for _, t, _ in segments if t is not None), None)
    if total is None or [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        return None
    block = b"".join(s[2] for s in segments)
    return block if len(block) == total else None


def _parsed(files: DataFrame, complete: bool) -> DataFrame:
    """Records of whole archive files: the complete ones, or the segments of those that a file does not hold whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                rows, open_ = [], {}
                for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    digest = _hex(h.get("warc-payload-digest", ""))
                    own, origin, segment = h.get("warc-record-id"), h.get("warc-segment-origin-id"), _number(h, "warc-segment-number")
                    row = [own, _number(h, "x-page-id"), h.get("warc-target-uri"), h.get("warc-type"), digest, _number(h, "x-refers-to-page-id"), origin or own, segment, _number(h, "warc-segment-total-length"), block, None]
                    if segment is None:
                        rows += [row] if complete else []
                    else:
                        open_.setdefault(origin or own, []).append(row)
                for parts in open_.values():
                    block = _assembled([(r[7], r[8], r[9]) for r in parts])
                    first = min(parts, key=lambda r: r[7])
                    if block is not None and complete:
                        rows.append([*first[:7], None, len(block), block, None])
                    elif block is None and not complete:
                        rows += parts
                for at in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1024], strict=True), KINDS, strict=True)], NAMES)

    return arrow_map(files, run, RECORDS)


def _decoded(records: DataFrame) -> DataFrame:
    """Payloads of complete records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, digest, block, error in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(9).to_pylist(), b.column(10).to_pylist(), strict=True):
                payload, n = None, None
                if error is None:
                    head, _, body = block.partition(b"\r\n\r\n") if kind in HTTP else (b"", b"", block)
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    try:
                        if kind == "revisit":
                            n = int(fields[b"content-length"]) if b"content-length" in fields else None
                        else:
                            payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                            n, own = len(payload), hashlib.sha1(payload).hexdigest()
                            error = None if digest in (None, own) else "the payload has another digest"
                            digest = own
                    except ValueError as e:
                        payload, error = None, str(e)
                rows.append((n, digest, payload, error))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            made = [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.binary(), pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(5), *made], ["record_id", "page_id", "uri", "type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"])

    return arrow_map(records, run, "record_id string, page_id long, uri string, type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``, segments reassembled: record_id,
    page_id, uri, type, refers_to, payload_bytes, payload_digest, payload and error.

    Records whose segments are missing, repeated differently or do not have the total
    length told, and bodies with broken chunks, have an error and no payload. A segment
    that is there twice with the same bytes counts once.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = _parsed(files, False).groupBy("origin").agg(F.array_sort(F.collect_set(F.struct("segment", "total", "block", "record_id", "page_id", "uri", "type", "digest", "refers_to"))).alias("s"))
    total = F.array_max(F.col("s.total"))
    block = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    whole = parts.select("*", total.alias("total"), block.alias("block"), F.sequence(F.lit(1).cast("long"), F.size("s").cast("long")).alias("numbers"))
    error = (
        F.when(F.col("s.segment") != F.col("numbers"), "segments are missing or repeated")
        .when(F.col("total").isNull(), "no segment tells the total length")
        .when(F.octet_length("block") != F.col("total"), "the segments do not have the total length")
    )
    first = F.col("s")[0]
    joined = whole.select(*(first[n].alias(n) for n in ("record_id", "page_id", "uri", "type", "digest", "refers_to")), "origin", F.lit(None).cast("long").alias("segment"), "total", "block", error.alias("error"))
    return _decoded(_parsed(files, True).union(joined))


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < target THEN target END AS refers_to
FROM m
"""
