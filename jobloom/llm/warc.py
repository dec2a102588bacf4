"""Operator 1: WARC archives written from a pages table, and a reader that salvages damaged ones.

Writing: one record per page, each a gzip member of its own. Of pages with equal payloads the one
with the largest id is stored, the others refer to it. Spark's text writer commits the files, so a
lost executor leaves no half archive: each record is a line whose separator is a zero byte, the
padding that gzip allows between members.

Reading: every archive is walked member by member (or version line by version line where it is not
compressed). A record counts only if its checks hold: gzip's checksum, a version line, a content
length that ends at a record end, and the payload digest. After a failed check the reader searches
for the next valid member or version line, recovers what follows, and reports the bytes between as
a quarantined gap. Of a damaged or cut gzip member, the records that were inflated before the damage and
hold by their own checks are recovered too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path
from . import common

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d+\.\d+\r\n")
READ_SCHEMA = ("archive string, offset long, inner long, length long, reason string, record_type string, record_id string, "
               "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary")

# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record; a revisit has no block."""
    block = HTTP_HEAD + payload if kind == "response" else b""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    lines.append(f"X-Payload-Length: {size}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + END + block + END


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_urn(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def with_revisits(pages: DataFrame, min_bytes: int, spread: int) -> DataFrame:
    """`page_id, url, payload, digest, size, refers_to`; `refers_to` is set for records that store no payload.

    Groups are counted on narrow rows with partial sums. Pages meet their group in `spread` parts
    each, so a payload that a third of the pages share fills no task alone.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    groups = (pages.where(F.col("size") >= min_bytes).groupBy("digest", "size")
              .agg(F.count("*").alias("n"), F.max("page_id").alias("stored"))
              .where("n > 1 and stored is not null")
              .select("digest", "size", "stored", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part")))
    pages = pages.withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.lit(spread)).cast("int"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    return pages.join(groups, ["digest", "size", "part"], "left").select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2026-01-01T00:00:00Z",
                   records_per_file: int = 20_000, spread: int = 64) -> None:
    """Write `pages(page_id, url, html)` as archives below `path`.

    A null `html` is an empty payload, a null `url` leaves the target out, a null id is written as
    `none`. Repeated rows with the largest id of their payload are each stored. An empty table writes
    no record. Other columns are ignored.
    """
    def build(batches):
        for batch in batches:
            rows = batch.to_pydict()
            yield pa.RecordBatch.from_arrays([pa.array([
                _gzip(record("response" if to is None else "revisit", page_urn(i), url, date, digest, size,
                             None if to is None else page_urn(to), payload))
                for i, url, payload, digest, size, to in zip(*(rows[c] for c in batch.schema.names))], pa.binary())], ["value"])

    common.ship(pages.sparkSession)
    ready = with_revisits(pages, min_bytes, spread)
    (ready.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path))


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------


class Found(NamedTuple):
    """A record (no reason) or a quarantined gap, at `offset` of the archive and `inner` of an inflated member."""

    offset: int
    inner: int | None
    length: int
    reason: str | None = None
    headers: dict | None = None
    payload: bytes = b""


def _member(data, start: int) -> tuple[bytes, int] | None:
    """Inflated bytes and end of the gzip member at `start`, or None if it is damaged or cut short."""
    unpacker, out, at = zlib.decompressobj(31), [], start
    try:
        while not unpacker.eof:
            if at >= len(data):
                return None
            piece = data[at:at + 65536]
            out.append(unpacker.decompress(piece))
            at += len(piece)
    except zlib.error:
        return None
    return b"".join(out), at - len(unpacker.unused_data)


def _inflated(data, start: int) -> bytes:
    """What a damaged or cut member gives up to the damage."""
    unpacker, out = zlib.decompressobj(31), []
    try:
        for at in range(start, len(data), 256):
            out.append(unpacker.decompress(data[at:at + 256]))
            if unpacker.eof:
                break
    except zlib.error:
        pass
    return b"".join(out)


def _record(data: bytes, start: int) -> tuple[dict, bytes, int] | str:
    """Headers, payload and end of the record at `start`, or the check that failed."""
    version = VERSION.match(data, start)
    if not version:
        return "no version line"
    head = data.find(END, version.end())
    if head < 0:
        return "headers not ended"
    if VERSION.search(data, version.end(), head):
        return "headers cut short"
    headers = {}
    for line in data[version.end():head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return "no content length"
    body, end = head + 4, head + 4 + int(length)
    if data[end:end + 4] != END:
        return "no record end"
    block = data[body:end]
    if block.startswith(b"HTTP/") and headers.get("content-type", "").startswith("application/http"):
        block = block.partition(END)[2]
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha1" and headers.get("warc-type") != "revisit" and _hex(digest) != hashlib.sha1(block).hexdigest():
        return "payload digest"
    return headers, block, end + 4


def _hex(digest: str) -> str | None:
    """A SHA-1 in base 32 or hex as lower-case hex."""
    try:
        return base64.b32decode(digest).hex() if len(digest) == 32 else bytes.fromhex(digest).hex()
    except ValueError:
        return None


def salvage(data: bytes) -> Iterator[Found]:
    """All valid records and all gaps of one archive, in order."""
    yield from _walk(data, None)


def _walk(data: bytes, member_at: int | None) -> Iterator[Found]:
    """`member_at`: where the gzip member starts whose inflated bytes `data` is; None for the archive itself."""
    at, lost, why = 0, None, ""

    def place(start: int, end: int, **more) -> Found:
        return Found(start if member_at is None else member_at, None if member_at is None else start, end - start, **more)

    while at < len(data):
        found, end = None, at
        if member_at is None and data.startswith(GZIP, at):
            member = _member(data, at)
            if member is None:
                failed = "damaged member"
                # records that were whole before the damage; the member's bytes are a gap all the same
                yield from (f for f in _walk(_inflated(data, at), at) if not f.reason)
            elif not NEXT.search(member[0]) and member[0]:
                failed = "member without records"
            else:
                found, end = list(_walk(member[0], at)), member[1]
                while end < len(data) and data[end] == 0:  # padding between members
                    end += 1
        else:
            got = _record(data, at)
            if isinstance(got, str):
                failed = got
            else:
                found, end = [place(at, got[2], headers=got[0], payload=got[1])], got[2]
        if found is not None:
            if lost is not None:
                yield place(lost, at, reason=why)
                lost = None
            yield from found
            at = end
            continue
        if lost is None:
            lost, why = at, failed
        following = NEXT.search(data, at + 1)
        at = following.start() if following else len(data)
    if lost is not None:
        yield place(lost, len(data), reason=why)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below `path`, by `READ_SCHEMA`; a gap has a `reason`, a record has none.

    An archive is one row of one task: keep archives to some hundred megabytes (`records_per_file`).
    Empty archives and empty folders give no rows. `payloads=False` leaves the payload column null.
    """
    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out = [_row(name.as_py(), f, payloads) for f in salvage(content.as_py() or b"")]
                for i in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_pylist(out[i:i + 1000], _ARROW)

    common.ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, READ_SCHEMA)


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                    for c in READ_SCHEMA.split(", ")])


def _row(archive: str, found: Found, payloads: bool) -> dict:
    h = found.headers or {}
    size = h.get("x-payload-length", "")
    return {"archive": archive, "offset": found.offset, "inner": found.inner, "length": found.length, "reason": found.reason,
            "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>") or None,
            "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": _hex(h.get("warc-payload-digest", "").partition(":")[2]) or None,
            "payload_bytes": None if found.reason else int(size) if size.isdigit() and h.get("warc-type") == "revisit" else len(found.payload),
            "payload": found.payload if payloads and not found.reason else None}


def records(read: DataFrame) -> DataFrame:
    return read.where("reason is null")


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return read.where("reason is not null").select("archive", "offset", "inner", "length", "reason")


def op1_warc_salvage(spark, sf):
    """Every page written to an archive and read back; see `write_archives` for nulls and ties."""
    path = fresh_path(spark, "warc")
    write_archives(common.table(spark, sf, "pages"), path)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return records(read_archives(spark, path, payloads=False)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS stored FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN stored IS NULL OR page_id IS NOT DISTINCT FROM stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM stored THEN stored END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
