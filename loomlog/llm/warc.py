"""WARC archives: one gzip member a record, repeats as revisits, and a reader that salvages damage."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import salted_lookup, text_of

#: Payloads from this size on are stored once and revisited.
REVISIT_BYTES = 1000
#: Payload bytes an archive is meant to hold; a reader holds one archive at a time.
ARCHIVE_BYTES = 16 << 20
#: Capture time of all records: a parameter, so that a repeated task writes the same bytes.
CAPTURED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "archive string, position long, length long, kind string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, problem string"
)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as bytes; a revisit has the header of the response only, not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member that ends in a zero byte: the size's top byte, or else an empty member's."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packed.compress(raw) + packed.flush()
    if data[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        data += empty.flush()
    return data


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) into ``folder``.

    The payload is the html in UTF-8, empty where null.  Of payloads of 1000 bytes or more with
    one SHA-1, the row with the largest page_id is the response and the others revisit it; rows
    that repeat that id are responses too.  Spark's text writer commits the files, so that any
    file system works and a lost executor leaves no half archive.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        text_of("html").cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    large = rows.filter(F.col("size") >= REVISIT_BYTES)
    repeats = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    pointed = salted_lookup(rows, repeats.filter("n > 1").drop("n"), ["digest"], ["page_id"], "left")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    per_file = max(1, int(archive_bytes * max(total.n, 1) / max(total.bytes, 1)))
    ready = pointed.select(
        "page_id", "url", "payload", "digest", F.col("response").alias("refers_to"),
        F.expr(f"size >= {REVISIT_BYTES} AND response IS NOT NULL AND NOT page_id <=> response").alias("revisit"),
    )
    # The text writer ends every row with the separator, here the zero byte that ends a member.
    ready.mapInArrow(_members, "member string").write.option("lineSep", "\x00").option(
        "maxRecordsPerFile", per_file
    ).text(folder)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256).to_pylist()
            data = pa.array([member(record(**row))[:-1] for row in part], pa.binary())
            # Same layout as a string column; the bytes are not text and pass through unread.
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(data), data.buffers())], ["member"])


class Found(NamedTuple):
    """A record (header and block) or, with ``problem`` set, a gap of bytes that held none."""

    position: int
    length: int
    headers: dict[str, str]
    block: bytes
    problem: str | None


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record at ``at``; ValueError where a check fails."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError("no version line")
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        raise ValueError("header has no end")
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start, end = head + 4, head + 4 + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = data[start:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:"):
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest[5:].lower():
            raise ValueError("payload digest differs")
    return headers, block, end + 4


def _next(data: bytes, at: int) -> int:
    """Where the next member or version line may start, at ``at`` or later."""
    found = [x for x in (data.find(b"\x1f\x8b\x08", at), data.find(b"WARC/1.", at)) if x >= 0]
    return min(found, default=len(data))


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, compressed by record or not, and the gaps between them.

    A member must inflate with its checksum; a record must have its version line, a length that
    leads to its end mark, and, for responses, the payload its digest says.  After a failed check
    the search goes on at the next member or version line that passes them all; the bytes between
    are reported as one gap.  Empty members and zero or line padding belong to no gap.
    """
    at, gap, problem = 0, None, ""
    while at < len(data):
        if gap is None and data[at] in b"\x00\r\n":
            at += 1
            continue
        found = []
        try:
            if data.startswith(b"\x1f\x8b", at):
                inflater = zlib.decompressobj(31)
                raw = inflater.decompress(memoryview(data)[at:])
                if not inflater.eof:
                    raise ValueError("member is cut off")
                end, inner = len(data) - len(inflater.unused_data), 0
                while inner < len(raw):
                    headers, block, inner = _parse(raw, inner)
                    found.append((headers, block))
            else:
                headers, block, end = _parse(data, at)
                found.append((headers, block))
        except (ValueError, zlib.error) as error:
            if gap is None:
                gap, problem = at, str(error)
            at = _next(data, at + 1)
            continue
        if gap is not None:
            yield Found(gap, at - gap, {}, b"", problem)
            gap = None
        for headers, block in found:
            yield Found(at, end - at, headers, block, None)
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, {}, b"", problem)


def _page(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and gap of the archives in ``folder`` (see ``RECORD_SCHEMA``).

    ``kind`` is the record type, or ``gap`` for quarantined bytes, then with ``problem``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("archive", pa.string()), ("position", pa.int64()), ("length", pa.int64()), ("kind", pa.string()),
             ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
             ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())]
        )
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                out = [_row(archive.as_py(), found) for found in salvage(content.as_py())]
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(rows, RECORD_SCHEMA)


def _row(archive: str, found: Found) -> dict:
    row = {"archive": archive, "position": found.position, "length": found.length, "kind": "gap", "problem": found.problem}
    if found.problem is not None:
        return row
    headers = found.headers
    http = found.block.partition(b"\r\n\r\n")[0].split(b"\r\n")
    sizes = [line.partition(b":")[2] for line in http if line.lower().startswith(b"content-length:")]
    return row | {
        "kind": headers.get("warc-type"),
        "page_id": _page(headers.get("warc-record-id", "")),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": int(sizes[0]) if sizes else len(found.block),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
        "refers_to": _page(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
    }
