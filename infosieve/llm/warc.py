"""Legacy archive converter (operator 8): ARC files to WARC files and back to rows.

``write_arc`` packs pages into ARC archives, ``read_arc`` parses them by their version's
header line and the declared lengths, ``convert`` synthesises the WARC records (identifier,
timestamp, type, digest), ``read_warc`` parses the result.  An archive is one binary value
of about ``ARCHIVE_BYTES``; archives are rows of a Parquet table, so writes are committed
by Spark and no archive passes through the driver.

Version 1 header lines are ``URL IP date type length``; version 2 adds result code,
checksum, location, offset and file name before the length.  The record identifier is a
custom (version 8) UUID that holds the page's number, so a revisit's ``WARC-Refers-To`` names
the page it repeats.

Among records with equal payloads of at least ``MIN_REVISIT`` bytes, those with the smallest
page number are responses and the others revisit them.

Defined results: a null ``html`` is an empty payload; a null ``page_id`` sorts after all
numbers and has an identifier of its own kind; rows that repeat the smallest number are all
responses; blanks and control characters in a URL are percent-encoded and a null URL becomes
``about:blank``; a header line that cannot be parsed ends the reading of that archive with
an error; extra columns are ignored; an empty table gives no archives; a
payload of any length is one record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ARCHIVE_BYTES = 4 << 20
MIN_REVISIT = 100
#: Legacy archives need a date and an address; pages carry neither.
DATE, ADDRESS = "20000101000000", "0.0.0.0"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")


def safe_url(url: str | None) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "surrogatepass")) or b"about:blank"


def record_id(page: int | None) -> str:
    digits = f"{(page or 0) & (2 ** 64 - 1):016x}"
    return f"urn:uuid:61726332-7761-87{0:x}{digits[0]}-{'b' if page is None else 'a'}{digits[1:4]}-{digits[4:]}"


def page_of(uri: str) -> int | None:
    *_, version, variant, node = uri.strip("<>").split("-")
    if variant[0] == "b":
        return None
    value = int(version[3] + variant[1:] + node, 16)
    return value - 2 ** 64 if value >= 2 ** 63 else value


def arc_head(name: str, version: int) -> bytes:
    body = f"{version} 0 infosieve\n{FIELDS[version]}\n\n".encode()
    if version == 1:
        return f"filedesc://{name} {ADDRESS} {DATE} text/plain {len(body)}\n".encode() + body
    return f"filedesc://{name} {ADDRESS} {DATE} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body


def arc_record(page: int | None, url: str | None, payload: bytes, version: int, name: str, offset: int) -> bytes:
    number = b"" if page is None else b"X-Page-Id: %d\r\n" % page
    doc = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (
        number, len(payload), payload)
    url_ = safe_url(url)
    if version == 1:
        head = b"%s %s %s text/html %d\n" % (url_, ADDRESS.encode(), DATE.encode(), len(doc))
    else:
        head = b"%s %s %s text/html 200 %s - %d %s %d\n" % (
            url_, ADDRESS.encode(), DATE.encode(), hashlib.md5(doc).hexdigest().encode(), offset, name.encode(), len(doc))
    return b"\n" + head + doc


def parse_arc(content: bytes) -> Iterator[tuple[bytes, str, bytes, bytes, int | None]]:
    """``url, date, http header, payload, page`` of every record, by declared lengths."""
    end = content.index(b"\n")
    size = int(content[:end].split(b" ")[-1])
    body = content[end + 1:end + 1 + size]
    version = int(body.split(b" ", 1)[0])
    fields = body.split(b"\n")[1].decode().split(" ")
    if version not in FIELDS or fields != FIELDS[version].split(" "):
        raise ValueError(f"unknown ARC version or header line: {body[:200]!r}")
    at = end + 1 + size
    while at < len(content):
        if content[at:at + 1] == b"\n":
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].split(b" ")
        if len(line) != len(fields) or not line[-1].isdigit() or len(line[2]) != 14:
            raise ValueError(f"bad ARC header line at byte {at}: {content[at:end][:200]!r}")
        size = int(line[-1])
        doc = content[end + 1:end + 1 + size]
        if len(doc) != size:
            raise ValueError(f"ARC record at byte {at} is cut short")
        head, _, payload = doc.partition(b"\r\n\r\n")
        number = re.search(rb"\r\nX-Page-Id: (-?\d+)", head)
        yield line[0], line[2].decode(), head + b"\r\n\r\n", payload, int(number[1]) if number else None
        at = end + 1 + size


def warc_record(page: int | None, url: bytes, date: str, head: bytes, payload: bytes, digest: str,
                refers_to: int | None) -> bytes:
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page)}>",
             f"WARC-Date: {when}", f"WARC-Target-URI: {url.decode()}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{record_id(refers_to)}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record, by declared lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"bad WARC record at byte {at}: {first[:80]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        size = int(head["Content-Length"])
        block = content[end + 4:end + 4 + size]
        if len(block) != size or content[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield head, block
        at = end + 8 + size


def _archives(rows: DataFrame, pack) -> DataFrame:
    """Archive rows ``name, content`` packed by ``pack(iterator of tuples) -> iterator of (name, bytes)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (t for b in batches for t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for name, content in pack(tuples):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())],
                                             names=["name", "content"])

    return rows.mapInArrow(run, "name string, content binary")


def write_arc(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stored ARC archives of ``pages``; versions 1 and 2 alternate within a task."""
    def pack(rows):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, None, 0
        for page, url, html in rows:
            version, name = 1 + seq % 2, f"part-{part}-{seq}.arc"
            if held is None:
                held = [arc_head(name, version)]
                size = len(held[0])
            held.append(arc_record(page, url, (html or "").encode("utf-8", "surrogatepass"), version, name, size))
            size += len(held[-1])
            if size >= archive_bytes:
                yield name, b"".join(held)
                held, seq = None, seq + 1
        if held:
            yield name, b"".join(held)

    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return stored(_archives(pages.select(F.col("page_id").cast("long"), url.alias("url"), "html"), pack), "arc")


def read_arc(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ARC archives: ``page_id, url, date, head, payload, n, digest``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got = [(page, url.decode(), date, head, payload if payloads else None, len(payload),
                        hashlib.sha256(payload).hexdigest())
                       for url, date, head, payload, page in parse_arc(content.as_py())]
                if got:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)],
                        names=["page_id", "url", "date", "head", "payload", "n", "digest"])

    return archives.select("content").mapInArrow(
        run, "page_id long, url string, date string, head binary, payload binary, n long, digest string")


def convert(archives: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Stored WARC archives of ARC archives, repeated payloads as revisits.

    Only digests that occur more than once and whose smallest page is known meet the records.
    """
    firsts = (read_arc(archives, payloads=False).where(F.col("n") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
              .where("times > 1 and first is not null").select(F.col("digest").alias("_digest"), "first"))
    firsts = stored(firsts, "warc-firsts")
    records = read_arc(archives)
    joined = records.join(firsts, records["digest"] == firsts["_digest"], "left")
    refers = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))

    def pack(rows):
        from pyspark import TaskContext
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for page, url, date, head, payload, digest, refers_to in rows:
            held.append(warc_record(page, url.encode(), date, head, payload, digest, refers_to))
            size += len(held[-1])
            if size >= archive_bytes:
                yield f"part-{part}-{seq}.warc", b"".join(held)
                held, size, seq = [], 0, seq + 1
        if held:
            yield f"part-{part}-{seq}.warc", b"".join(held)

    return stored(_archives(joined.select("page_id", "url", "date", "head", "payload", "digest", refers.alias("r")),
                            pack), "warc")


def read_warc(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                got = []
                for head, block in parse_warc(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind, refers = head["WARC-Type"], head.get("WARC-Refers-To")
                    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                    got.append((page_of(head["WARC-Record-ID"]), size, digest, kind, page_of(refers) if refers else None))
                if got:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("content").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC archives and back."""
    return read_warc(convert(write_arc(pages)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
