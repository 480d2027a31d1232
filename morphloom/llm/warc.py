"""WARC archives of pages, written by Spark's text sink and read by a salvage reader.

``write_warc`` makes one gzip member for each record. Members are gathered in chunks of bounded
bytes, zero-padded apart by the text sink's separator (gzip allows zeros after a member), so the
files go through Spark's committer to any file system and have bounded size. Of records with
equal payloads (by digest, of at least ``min_bytes``), the one with the largest ``page_id`` is
the response and the others revisit it. Who revisits whom is found on ids and digests alone;
payloads are dealt once, by (digest, id), so that no common payload is hot.

``salvage`` reads archives with compressed and plain records. After a failed check (gzip CRC,
version line, lengths, digests) it searches for the next gzip member or version line that holds
a valid record, goes on there, and reports the bytes in between as a quarantined gap. Inside a
member the same search goes over the inflated bytes, also over those before a gzip error. The
search is one scan forward: a candidate is given up at its first bad line or length.

Edge cases: a null html is an empty payload; rows that tie at the largest ``page_id`` are all
responses, the first of them being the one that revisits name; record ids are unique, equal rows
are numbered; a payload group whose ids are all null has only responses; a null url has no
target; other columns are not looked at; an empty table gives an empty archive. One payload is
in memory at a time with its compressed form; a file is read as one row, so archives from
elsewhere must be under 2 GB each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphloom.llm.keys import join_counted
from morphloom.storage import materialize

#: Compressed bytes of a chunk of members, and chunks of a file; one longer record is a chunk of its own.
CHUNK_BYTES, CHUNKS_PER_FILE = 8 << 20, 8
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None, digest: str, copy: int = 0) -> str:
    """A record's id: its page, its payload, and which of equal rows it is."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{copy}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's HTTP header only."""
    digest = base32_sha1(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id, digest, copy)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {urn(refers_to, digest)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files."""
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = materialize(rows.where(F.octet_length("html") >= F.lit(min_bytes)).select("page_id", "digest"), "payloads")
    keys = narrow.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    older = join_counted(narrow, materialize(keys, "copies"), "digest", narrow.count()).where("page_id IS NULL OR page_id < kept").distinct()
    # what a row refers to comes first, then the rows of that id and digest, each with its payload
    none = lambda kind: F.lit(None).cast(kind)
    named = older.select("digest", "page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("string").alias("html"), "kept")
    given = rows.select("digest", "page_id", F.lit(1).alias("kind"), "url", "html", none("bigint").alias("kept"))
    met = named.unionByName(given).repartition("digest", "page_id").sortWithinPartitions("digest", "page_id", "kind", "url")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        at, refers, copy = None, None, 0
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("digest", "page_id", "kind", "url", "kept")))
            for (digest, page, kind, url, kept), html in zip(keys, b.column("html")):
                if (digest, page) != at:
                    at, refers, copy = (digest, page), None, 0
                if kind == 0:
                    refers = kept
                    continue
                yield member(record(page, url, html.as_py().encode("utf-8", "surrogatepass"), refers, copy))
                copy += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for one in members(batches):
            if held and size + len(one) > chunk_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                held, size = [], 0
            held.append(one)
            size += len(one)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    made = met.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    made.write.option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path, lineSep="\0")


@dataclass
class Found:
    """A record, or a gap (then ``reason`` says what failed first) of ``length`` bytes at ``offset``."""

    offset: int
    length: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None


class Damaged(ValueError):
    pass


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at ``at``, if every check holds."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damaged("no version line")
    headers, line_at = {}, at + 10
    while True:  # line by line: what is no header ends the search at once
        end = data.find(b"\r\n", line_at)
        if end == line_at:
            break
        name, colon, value = data[line_at:end].partition(b":") if end > 0 else (b"", b"", b"")
        if end < 0 or not colon:
            raise Damaged("headers do not end" if end < 0 else "a header has no colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "surrogatepass" if _valid(value) else "replace").strip()
        line_at = end + 2
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Damaged("no content length")
    start, size = end + 2, int(headers["content-length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise Damaged("the block is cut or its length is wrong")
    block = data[start : start + size]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        raise Damaged("the block's digest differs")
    return headers, block, start + size + 4


def _valid(value: bytes) -> bool:
    try:
        value.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, where it ends, and what is wrong with it."""
    inflate, parts, end = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and end < len(data):
            parts.append(inflate.decompress(data[end : end + 65536]))
            end = min(end + 65536, len(data))
    except zlib.error as e:
        return b"".join(parts), end, f"gzip: {e}"
    return b"".join(parts), end - len(inflate.unused_data), None if inflate.eof else "gzip: the member is cut"


class _Next:
    """Where a pattern occurs next; each byte is searched once."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.at = data, pattern, -1

    def after(self, at: int) -> int:
        if self.at <= at:
            found = self.data.find(self.pattern, at + 1)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def _plain_records(data: bytes) -> Iterator[Found]:
    """Records and gaps of inflated bytes."""
    at, gap, reason, version = 0, None, "", _Next(data, _VERSION)
    while at < len(data):
        try:
            headers, block, end = _plain(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = version.after(at)
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason=reason)
            gap = None
        yield Found(at, end - at, headers, block)
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, reason=reason)


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order; together they cover all bytes but zero padding.

    Records of a member have the member's place. A gap inside a sound member is the member again,
    with the reason; records saved from the front of a broken member have no length, and the gap
    that follows covers the member.
    """
    at, gap, reason = 0, None, ""
    member_at, version_at = _Next(data, _MEMBER), _Next(data, _VERSION)
    while at < len(data):
        if data[at] == 0 and gap is None:
            at += 1
            continue
        saved: list[Found] = []
        try:
            if data[at : at + 3] != _MEMBER:
                headers, block, end = _plain(data, at)
                found = [Found(at, end - at, headers, block)]
            else:
                whole, end, wrong = _inflated(data, at)
                found = [Found(at, end - at, f.headers, f.block, f.reason and f"inside a member, {f.length} bytes at {f.offset}: {f.reason}") for f in _plain_records(whole)]
                if wrong or not any(f.headers for f in found):
                    saved = [Found(at, 0, f.headers, f.block) for f in found if f.headers]
                    raise Damaged(wrong or (found[0].reason if found else "an empty member"))
        except Damaged as e:
            if saved and gap is not None:
                yield Found(gap, at - gap, reason=reason)
                gap = None
            yield from saved
            if gap is None:
                gap, reason = at, str(e)
            at = min(member_at.after(at), version_at.after(at))
            continue
        if gap is not None:
            yield Found(gap, at - gap, reason=reason)
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield Found(gap, len(data) - gap, reason=reason)


RECORDS = "path string, offset bigint, length bigint, reason string, record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+):.*>", urn or "")
    return int(m[1]) if m else None


def _row(path: str, f: Found, payloads: bool) -> tuple:
    if f.headers is None:
        return (path, f.offset, f.length, f.reason, *[None] * 7)
    h = f.headers
    head, blank, payload = f.block.partition(b"\r\n\r\n")
    kind = h.get("warc-type")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", head) if blank else None
    n = int(size[1]) if size and kind == "revisit" else len(payload)
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else base32_sha1(payload)
    reason = "the payload's digest differs" if h.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}" else None
    return (path, f.offset, f.length, reason, kind, _page(h.get("warc-record-id")), h.get("warc-target-uri"), _page(h.get("warc-refers-to")), n, digest, payload if payloads else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record and each quarantined gap (``record_type`` null, ``reason`` set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for f in salvage(content.as_py()):
                    rows.append(_row(name, f, payloads))
                    held += len(f.block)
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=[x.split()[0] for x in RECORDS.split(", ")])
