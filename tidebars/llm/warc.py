"""WARC archives: a writer with revisit records, and a reader that salvages what lies behind damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.columns import materialize, new_folder, text_or_empty

# fixed values of the format
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
NEXT = re.compile(rb"\nWARC/\d+\.\d+\r?\n")
MEMBER = b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
DATE = "2024-01-01T00:00:00Z"

PAGES_PER_FILE = 5_000
LEVEL = 3
RECORD = ("file string, offset long, length long, kind string, record_id string, uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary, reason string")


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One response, or a revisit that leaves the payload out but keeps its digest and length."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"),
            f"WARC-Record-ID: <urn:page:{page}>".encode(), f"WARC-Date: {DATE}".encode(),
            b"WARC-Payload-Digest: sha1:" + digest(payload).encode()]
    if uri is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri).encode("utf-8", "replace"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: " + SAME_PAYLOAD.encode()]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member of its own."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _written(compress: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, uri, html, first in zip(batch["page"], batch["uri"], batch["html"], batch["first"], strict=True):
                data = record("null" if page is None else page, uri, html.encode("utf-8", "surrogatepass"), first)
                out.append(member(data) if compress else data[:-4])
            yield pd.DataFrame({"data": out})
    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", html: str = "html",
                   compress: bool = True, pages_per_file: int = PAGES_PER_FILE) -> None:
    """A record per row, in files of at most ``pages_per_file`` records, gzip member by member or plain.

    Of rows with equal payloads (by SHA-1 and length) that with the smallest key is the response; the others
    refer to it. Only payloads that occur more than once are joined back: while they are few, nothing but
    hashes is shuffled. Null html is an empty payload, also shared. A missing url leaves its header out. Rows
    that repeat key and payload are responses all; a row without a key refers to one that has a key. An empty
    table writes archives without records. Spark's text writer puts the bytes down, so any store it knows
    serves: between records stands the separator of plain archives or an empty gzip member.
    """
    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(key).alias("k"), F.col(uri).cast("string").alias("uri"),
                        text_or_empty(html).alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    shared = materialize(rows.groupBy("sha", F.octet_length("html").alias("size"))
                         .agg(F.count("*").alias("n"), F.min("k").cast("string").alias("lowest"))
                         .filter("n > 1 and lowest is not null").select(F.col("sha").alias("s"), "size", "lowest"))
    told = rows.join(shared, (F.col("sha") == F.col("s")) & (F.octet_length("html") == F.col("size")), "left").select(
        "page", "uri", "html", F.when(F.col("page").isNull() | (F.col("page") != F.col("lowest")), F.col("lowest")).alias("first"))
    between = EMPTY_MEMBER.decode("latin-1") if compress else "\r\n\r\n"
    (told.mapInPandas(_written(compress), "data binary").select(F.col("data").cast("string").alias("value"))
     .write.option("lineSep", between).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", pages_per_file).text(path))


@dataclass
class Found:
    """A record at some place, or why there is none."""

    end: int = -1
    head: dict[str, str] | None = None
    block: bytes = b""
    reason: str = ""


def _plain(data: bytes, at: int) -> Found:
    line = VERSION.match(data, at)
    if line is None:
        return Found(reason="no version line")
    following = NEXT.search(data, line.end() - 1)
    stop = data.find(b"\r\n\r\n", line.end() - 2, following.start() + 1 if following else len(data))
    if stop < 0:
        return Found(reason="header without end")
    head = {}
    for row in data[line.end():stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if colon:
            head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = head.get("content-length", "")
    if not size.isdigit():
        return Found(reason="no content length")
    begin, end = stop + 4, stop + 4 + int(size)
    if end > len(data):
        return Found(reason="truncated block")
    if data[end:end + 4] != b"\r\n\r\n":
        return Found(reason="no separator after the block")
    block = data[begin:end]
    if head.get("warc-type") == "response":
        told = head.get("warc-payload-digest", "")
        if told.startswith("sha1:") and told[5:] != digest(_payload(block)):
            return Found(reason="payload digest differs")
    return Found(end + 4, head, block)


def _payload(block: bytes) -> bytes:
    at = block.find(b"\r\n\r\n")
    return block[at + 4:] if block.startswith(b"HTTP/") and at >= 0 else block


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``at``, whose checksum zlib has compared; or a reason."""
    unpack, parts, step = zlib.decompressobj(31), [], 1 << 16
    pos = at
    try:
        while not unpack.eof and pos < len(data):
            parts.append(unpack.decompress(data[pos:pos + step]))
            pos += step
    except zlib.error as error:
        return b"", -1, f"damaged member: {error}"
    if not unpack.eof:
        return b"", -1, "truncated member"
    return b"".join(parts), min(pos, len(data)) - len(unpack.unused_data), ""


def found_at(data: bytes, at: int) -> Found:
    """What begins at ``at``: a checked record, an empty member (no head), or the reason of the failure."""
    if data.startswith(MEMBER, at):
        content, end, reason = _inflated(data, at)
        if reason:
            return Found(reason=reason)
        if not content:
            return Found(end)
        inner = _plain(content, 0)
        if inner.reason:
            return inner
        return Found(end, inner.head, inner.block) if inner.end == len(content) else Found(reason="more than a record in a member")
    return _plain(data, at)


def salvage(data: bytes) -> Iterator[tuple[int, int, Found]]:
    """(start, end, found) over an archive: records in order, and between them each gap with its reason.

    After a failed check the next place is sought where a gzip member or a version line begins and all checks
    hold; the bytes before it are one gap.
    """
    at = 0
    begins = re.compile(re.escape(MEMBER) + rb"|WARC/\d")
    while at < len(data):
        here = found_at(data, at)
        start = at
        reason = here.reason
        while here.reason:
            seen = begins.search(data, at + 1)
            if seen is None:
                at = len(data)
                break
            at = seen.start()
            here = found_at(data, at)
        if at > start:
            yield start, at, Found(at, None, b"", reason)
        if at < len(data):
            if here.head is not None:
                yield at, here.end, here
            at = here.end


def _read(payloads: bool):
    def row(file: str, start: int, end: int, found: Found) -> dict:
        if found.reason:
            return {"file": file, "offset": start, "length": end - start, "kind": "gap", "reason": found.reason}
        head, payload = found.head, _payload(found.block)
        size = len(payload)
        if head.get("warc-type") == "revisit":
            told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", found.block)
            size = int(told[1]) if told else None
        return {"file": file, "offset": start, "length": end - start, "kind": head.get("warc-type"),
                "record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
                "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": size,
                "payload": payload if payloads else None}

    names = [part.split()[0] for part in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for start, end, found in salvage(data):
                    rows.append(row(file, start, end, found))
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of all archives below ``path``: one per record, and one of kind ``gap`` per run of lost bytes.

    A task holds one archive at a time, so its size bounds memory; the writer bounds that size. A record that
    fails a check (checksum of its member, header, length, separator, payload digest) is never returned, and
    the records behind it are. Columns that a record does not have are null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.filter(F.octet_length("content") > 0).mapInPandas(_read(payloads), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """What the archives of ``pages`` say when they are read back, a row per page."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return (read_archives(spark, path, payloads=False).filter(F.col("kind").isin("response", "revisit"))
            .select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                    page("refers_to").alias("refers_to")))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
         min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(CAST('0x' || substr(hex, CAST(i AS INT), 1) AS INT) + 16), 4)), '') AS b
  FROM k)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - j) AS INT))) AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""
