"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own.  Archives are bounded: a task rolls over to a new archive at
`ARCHIVE_BYTES`.  An archive is stored as blocks
in a table of the shared folder, so that a lost executor's work is simply done again and any store that
Spark can write will do.  The reader takes a stream of blocks (or the content of a .warc.gz file), inflates
it member by member, frames records by Content-Length and verifies digests.  It reads archives of other
writers as well: records of any type, with HTTP headers or without.

Of pages with equal payloads of at least `least` bytes the one with the smallest id is a response, the
others are revisits that name it and carry the payload's digest but no payload.  Null html is an empty
payload, and a very long one is one record.  Rows that repeat an id with the same payload are records of their
own of the same kind as the id, with record ids of their own; those with a null id are responses.  An empty table
gives no archive and no record.  Columns besides the three are ignored, whatever their names.  Damaged or cut off
records raise ValueError.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

ARCHIVE_BYTES = 32 << 20
BLOCK_BYTES = 1 << 18
#: Bytes given to the inflater at once, which bounds what is copied where a member ends.
FEED_BYTES = 1 << 14
# Names of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


class Record(NamedTuple):
    headers: dict[str, str]  # names in lower case, as they may be written in any
    block: bytes

    @property
    def payload(self) -> bytes:
        """The block, less the HTTP headers that stand before a page."""
        if self.headers.get("content-type", "").replace(" ", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(headers: dict[str, str], payload: bytes, level: int = 4) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(payload))}.items())
    deflate = zlib.compressobj(level, wbits=31)
    return b"".join([deflate.compress(f"{VERSION}\r\n{head}\r\n".encode()), deflate.compress(payload), deflate.compress(b"\r\n\r\n"), deflate.flush()])


def members(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """What each gzip member of the stream holds; members may end anywhere within a block."""
    inflate, parts, begun = zlib.decompressobj(wbits=31), [], False
    for block in blocks:
        for at in range(0, len(block), FEED_BYTES):
            piece = block[at : at + FEED_BYTES]
            while piece:
                begun = True
                parts.append(inflate.decompress(piece))
                piece = inflate.unused_data
                if inflate.eof:
                    yield b"".join(parts)
                    inflate, parts, begun = zlib.decompressobj(wbits=31), [], False
    if begun:
        raise ValueError("the archive ends within a member")


def _differs(stated: str | None, data: bytes) -> bool:
    """Whether a stated SHA-1, in base32 or hexadecimal, is not that of the data; digests of other kinds are not tested."""
    kind, _, value = (stated or "").partition(":")
    return kind.lower() == "sha1" and value.upper() != digest(data) and value.lower() != hashlib.sha1(data).hexdigest()


def read(blocks: Iterable[bytes], *, verify: bool = True) -> Iterator[Record]:
    """Records of an archive, in order; digests are verified where a record has them."""
    for raw in members(blocks):
        head, gap, body = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not gap or not version.startswith("WARC/"):
            raise ValueError("no record header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        record = Record(headers, body[:length])
        if len(record.block) != length or body[length:].strip(b"\r\n"):
            raise ValueError("a record's length differs from Content-Length")
        if verify and _differs(headers.get("warc-block-digest"), record.block):
            raise ValueError("WARC-Block-Digest does not match")
        if verify and headers.get("warc-type") != "revisit" and _differs(headers.get("warc-payload-digest"), record.payload):
            raise ValueError("WARC-Payload-Digest does not match")
        yield record


def _written(archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, block, parts, size, total = None, 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal block, parts, size
            out = pa.record_batch({"archive": [archive], "block": pa.array([block], pa.int32()), "data": pa.array([b"".join(parts)], pa.binary())})
            block, parts, size = block + 1, [], 0
            return out

        for b in batches:
            for page, url, kind, payload, sha, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive is None or total >= archive_bytes:
                    if parts:
                        yield flush()
                    archive, block, total = uuid.uuid4().hex, 0, 0
                headers = {
                    "WARC-Type": kind,
                    "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Date": date,
                    "WARC-Target-URI": _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url or ""),
                    "Content-Type": "text/html; charset=utf-8",
                    "WARC-Payload-Digest": f"sha1:{sha}",
                    "Page-Payload-Length": str(len(payload or b"")),
                }
                if page is not None:
                    headers["Page-Id"] = str(page)
                if kind == "revisit":
                    headers |= {"Page-Refers-To": str(refers), "WARC-Profile": IDENTICAL}
                body = b"" if kind == "revisit" else payload or b""
                record = pack(headers | {"WARC-Block-Digest": f"sha1:{digest(body)}"}, body)
                parts.append(record)
                size, total = size + len(record), total + len(record)
                if size >= BLOCK_BYTES:
                    yield flush()
        if parts:
            yield flush()

    return run


def _row(r: Record) -> tuple:
    h, whole = r.headers, r.payload
    number = lambda name: int(h[name]) if h.get(name, "").lstrip("-").isdigit() else None
    stated = number("page-payload-length")
    sha = h.get("warc-payload-digest", "").removeprefix("sha1:") or digest(whole)
    return (number("page-id"), h.get("warc-target-uri"), h.get("warc-type"), len(whole) if stated is None else stated, sha, number("page-refers-to"), whole)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come by archive and in order; each archive is read as one stream."""

    def stream() -> Iterator[tuple[str, bytes]]:
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield archive, data

    held: list = []

    def of(first: bytes, rest: Iterator[tuple[str, bytes]], archive: str) -> Iterator[bytes]:
        yield first
        for name, data in rest:
            if name != archive:
                held.append((name, data))
                return
            yield data

    source = stream()
    names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    start = next(source, None)
    while start is not None:
        rows: list[tuple] = []
        size = 0
        for r in read(of(start[1], source, start[0])):
            rows.append(_row(r))
            size += len(r.block)
            if size >= BLOCK_BYTES:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        start = held.pop() if held else None


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def write_archives(spark: SparkSession, pages: DataFrame, *, least: int = 0, work: Workspace | None = None, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """A written table (archive, block, data) of the records of pages (page_id, url, html), all of one date (now, if none is given)."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    work = work or Workspace(spark, "warc")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    # equal payloads: the first page by an aggregate with map-side partials, joined back by the payload's key
    first = keyed.where(F.octet_length("payload") >= least).groupBy("key").agg(F.min("page_id").alias("first"))
    revisit = F.col("page_id") > F.col("first")
    rows = keyed.join(first, "key", "left").select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("kind"), "payload", F.when(revisit, F.col("first")).alias("refers"))
    return work.put(rows.mapInArrow(_with_digest, "page_id long, url string, kind string, payload binary, sha string, refers long").mapInArrow(_written(archive_bytes, date), "archive string, block int, data binary"), "archives")


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = pa.array([digest(x or b"") for x in b.column(3).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], sha, b.column(4)], ["page_id", "url", "kind", "payload", "sha", "refers"])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the archives (archive, block, data)."""
    return archives.repartition("archive").sortWithinPartitions("archive", "block").mapInArrow(_records, READ)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files of any writer; a file is one stream and one task's row, so it is bounded by what a row may hold (2 GB, mostly 1 GB by custom)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select(F.col("path").alias("archive"), F.lit(0).alias("block"), F.col("content").alias("data")).mapInArrow(_records, READ)
