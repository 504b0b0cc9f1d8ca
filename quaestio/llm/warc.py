"""Operator 7: WARC archives, written, and read back by a salvage reader.

Pages become WARC/1.1 records, each a gzip member of its own: the first of equal
payloads (smallest page_id) a response, the others revisits that name it. Spark's text
writer puts the members of a task into one file; archives hold about ARCHIVE_BYTES.

The reader goes through a file member by member, and through the content of a member (or
of a file without compression) version line by version line. Where a record is cut short,
its headers are broken or its payload misses its digest, it searches for the next valid
version line, goes on from there and logs the bytes it skipped as a gap: other records of
the member stay. Where a member cannot be decompressed to its end, the whole records of
what came out stay, and the reader goes on at the next member that yields any. ``offset``
and ``gap_end`` are places in the file, ``inner_offset`` and ``inner_end`` places in the content of
the member that begins at ``offset`` (null without compression). An archive is read as one
row, so archives must be under 2 GB; the writer makes them of about ARCHIVE_BYTES.

Nulls and odd input: a null html is the empty payload; a null page_id is carried as an
empty id (of equal payloads without any id, all are responses); rows that repeat in full
with the smallest id are all responses. Empty tables give no archives. Further columns
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.llm.shared import new_path, small, stored

ARCHIVE_BYTES = 16 << 20
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"

RECORDS = ("path string, offset long, record_type string, target_uri string, refers_to_id string, payload_bytes long, "
           "payload_digest string, page_id long, payload binary, is_gap boolean, gap_end long, reason string, "
           "inner_offset long, inner_end long")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record. A revisit holds the headers of its response, without the payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE),
            ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}")]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{first}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    return (VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n")


#: A member of nothing. It ends in a zero byte (its length), which the text writer adds
#: itself as the separator of rows.
_NOTHING = gzip.compress(b"", mtime=0)


def member(content: bytes) -> bytes:
    """A gzip member that ends in a zero byte, without that byte."""
    out = gzip.compress(content, compresslevel=1, mtime=0)
    return out[:-1] if out[-1] == 0 else out + _NOTHING[:-1]


def _members(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield pa.RecordBatch.from_arrays([pa.array([
            member(record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["first"], r["revisit"]))
            for r in batch.to_pylist()], pa.binary())], names=["value"])


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [(sha1(x), len(x)) for x in ((h or "").encode("utf-8", "surrogatepass") for h in batch.column("html").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([d for d, _ in found], pa.string()),
                                          pa.array([n for _, n in found], pa.int64())], names=["page_id", "digest", "n"])


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """The archives of ``pages`` (page_id, url, html) under ``path``. Payloads under
    ``least_bytes`` are responses even if they repeat."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    digests = stored(pages.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, n long"), "page-digests")
    total = digests.agg(F.sum("n")).first()[0]
    if total is None:
        return
    # a page is a revisit if its payload has a smaller id; rows of one id share one answer
    equal = digests.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    again = (digests.filter(F.col("n") >= least_bytes).join(equal.filter("c > 1"), "digest")
             .filter(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()))
             .select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first").distinct())
    digest_of = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    again = stored(again, "page-revisits")
    rows = pages.withColumn("_own", _base32(digest_of))
    rows = rows.join(small(again, 128), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left")
    rows = rows.select("page_id", "url", "html", "first", F.col("_digest").isNotNull().alias("revisit"))
    archives = max(1, -(-total // ARCHIVE_BYTES))
    rows = rows.repartition(int(archives), F.xxhash64("page_id", "url", "html"))
    (rows.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\0").text(path))


def _base32(hexadecimal):
    """Base32 of a 40-digit hex string: 8 letters of 5 bits for each 10 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for part in range(4):
        number = F.conv(F.substring(hexadecimal, 10 * part + 1, 10), 16, 10).cast("long")
        out += [F.substring(letters, (F.shiftright(number, 5 * (7 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


@dataclass
class Parsed:
    """A record, or (is_gap) bytes that were skipped and why."""
    offset: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    is_gap: bool = False
    reason: str = ""
    inner: int | None = None
    inner_end: int | None = None


class Broken(Exception):
    pass


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header without colon")
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes, at: int = 0) -> tuple[Parsed, int]:
    """The record whose version line stands at ``at``, and where it ends."""
    if not (m := _VERSION_LINE.match(data, at)):
        raise Broken("no version line")
    head = data.find(b"\r\n\r\n", m.end() - 2)
    if head < 0:
        raise Broken("headers cut short")
    headers = _headers(data[m.end():head].split(b"\r\n") if head > m.end() else [])
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        raise Broken("no content length") from None
    start, end = head + 4, head + 4 + n
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Broken("no type or record id")
    if n < 0 or end + 4 > len(data) or data[end:end + 4] != b"\r\n\r\n":
        raise Broken("block cut short or too long")
    block, http, payload = data[start:end], {}, b""
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise Broken("http headers cut short")
        http, payload = _headers(block[:cut].split(b"\r\n")[1:]), block[cut + 4:]
    else:
        payload = block
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        algorithm, _, digest = headers.get(name, "").partition(":")
        if algorithm == "sha1" and not (name[5] == "p" and headers.get("warc-type") == "revisit") and digest != sha1(content):
            raise Broken(f"{name[5:]} does not match")
    return Parsed(at, end + 4, headers, http, payload), end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Of the gzip member at ``at`` what can be decompressed, its end, and what broke it ('' if whole)."""
    z, out, end = zlib.decompressobj(31), [], at
    try:
        while not z.eof and end < len(data):
            out.append(z.decompress(data[end:end + 65536]))
            end = min(end + 65536, len(data))
    except zlib.error as e:
        return _more(data, at, b"".join(out), end), end, f"member: {e}"
    return b"".join(out), end - len(z.unused_data), "" if z.eof else "member cut short"


def _more(data: bytes, at: int, known: bytes, end: int) -> bytes:
    """The content up to a broken place: after whole blocks (``known``, from the bytes up to ``end``)
    the bytes of the broken one are fed singly."""
    z = zlib.decompressobj(31)
    out = [z.decompress(data[at:end])]
    try:
        for k in range(end, min(end + 65536, len(data))):
            out.append(z.decompress(data[k:k + 1]))
    except zlib.error:
        pass
    return b"".join(out) or known


def _plain(data: bytes) -> Iterator[Parsed]:
    """The records of uncompressed content in order, with gaps."""
    at = 0
    while at < len(data):
        try:
            found, end = parse(data, at)
            yield found
        except Broken as e:
            end = _next_line(data, at + 1)
            yield Parsed(at, end, is_gap=True, reason=str(e))
        at = end


def _next_line(data: bytes, at: int) -> int:
    """Where the next version line of a whole record stands, or the end."""
    while m := _VERSION_LINE.search(data, at):
        try:
            parse(data, m.start())
            return m.start()
        except Broken:
            at = m.start() + 1
    return len(data)


def _next_member(data: bytes, at: int) -> int:
    """Where the next member stands that is whole or yields a record, or the end."""
    while (at := data.find(_MEMBER, at)) >= 0:
        content, _, error = _inflate(data, at)
        if not error or any(not r.is_gap for r in _plain(content)):
            return at
        at += 1
    return len(data)


def salvage(data: bytes) -> Iterator[Parsed]:
    """The records of an archive in order, with a gap wherever bytes had to be skipped."""
    zip_at, plain = data.find(_MEMBER), _VERSION_LINE.search(data)
    if zip_at < 0 or (plain is not None and plain.start() < zip_at):
        yield from _plain(data)
        return
    at = 0
    while at < len(data):
        content, end, error = _inflate(data, at)
        if error:
            end = _next_member(data, at + 1)
        lost = len(content)
        for found in _plain(content):
            if error and found.is_gap and found.end == len(content):
                lost = found.offset  # what the broken member goes on with is one gap with its rest
                break
            found.inner, found.inner_end, found.offset, found.end = found.offset, found.end, at, end
            yield found
        if error:
            yield Parsed(at, end, is_gap=True, reason=error, inner=lost)
        at = end


def _page(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def _salvaged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORDS.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
    for batch in rows:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            out, size = [], 0
            for r in salvage(content.as_py()):
                h = r.headers
                kind = h.get("warc-type")
                n = int(r.http.get("content-length", "0") or 0) if kind == "revisit" else len(r.payload)
                name = _page(h.get("warc-record-id", ""))
                out.append((path, r.offset, kind, h.get("warc-target-uri"), _page(h["warc-refers-to"]) if "warc-refers-to" in h else None,
                            n, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(name) if re.fullmatch(r"-?\d+", name) else None,
                            r.payload, r.is_gap, r.end if r.is_gap else None, r.reason or None, r.inner, r.inner_end))
                size += len(r.payload)
                if size > 4 << 20:
                    yield batch_of(out)
                    out, size = [], 0
            if out:
                yield batch_of(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and (is_gap) quarantined byte gaps of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back; per record page_id, payload_bytes,
    payload_digest, record_type and refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write(pages, path, least_bytes)
    return (read(spark, path).filter(~F.col("is_gap"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").cast("long").alias("refers_to")))


#: DuckDB twin of the query; base32 by 5-bit groups of the hex digest.
ORACLE = r"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, payload_bytes, hex,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS INTEGER), 10) AS BIGINT) >> CAST(5 * (7 - i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT d.page_id, payload_bytes, payload_digest,
  CASE WHEN d.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN d.page_id = f.first THEN NULL ELSE f.first END AS refers_to
FROM d JOIN f ON d.hex = f.hex
"""
