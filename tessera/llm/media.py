"""Media columns: lossless 8-bit PNG in binary columns, read back by chunk, with a perceptual hash.

encode() writes a payload as a greyscale PNG of 64 samples a row; decode() walks the chunks, tests each
checksum, inflates the image data and undoes the row filters with numpy.  The hash has the signs, against
their median, of the lowest frequencies of the two-dimensional cosine transform.  Cosines are rounded to
integers, so all sums are exact and equal payloads have equal hashes on any machine.

Null texts count as empty; an empty payload is one row of zero samples, and a very long one is one image.
Equal texts, also those of rows that repeat an id or have none, give equal values; each row is its own image.
An empty table gives an empty result, and columns besides id and text are ignored, whatever their names.  A damaged image raises
ValueError from decode() and gives null features from read_media().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
# The signature and the colour type of a greyscale PNG.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = 0

FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    """raw with zero bytes up to a positive multiple of width."""
    return raw + bytes(-len(raw) % width if raw else width)


def encode(payload: bytes, width: int = WIDTH, level: int = 2) -> bytes:
    """A greyscale PNG with `width` samples a row; each row is filtered by none, left or up, whichever leaves least."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = [np.minimum(x, -x).sum(axis=1, dtype=np.int64) for x in (rows, left, up)]
    kind = np.argmin(cost, axis=0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.choose(kind[:, None], (rows, left, up))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(image: bytes) -> Iterator[tuple[bytes, memoryview]]:
    """(kind, data) of each chunk, its length and checksum tested."""
    if image[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, view = 8, memoryview(image)
    while at < len(view):
        if at + 12 > len(view):
            raise ValueError("a chunk is cut off")
        (size,) = struct.unpack_from(">I", view, at)
        kind, data = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        if at + 12 + size > len(view) or struct.unpack_from(">I", view, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, data
        at += 12 + size


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered rows, one byte a sample; the first column has the filters."""
    kind, x = lines[:, 0], lines[:, 1:].copy()
    plain = np.flatnonzero(kind == 1)
    x[plain] = np.cumsum(x[plain], axis=1, dtype=np.uint8)
    # a run of rows filtered by up is a running sum below the row before it
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (kind == 2).view(np.int8), [0]])))
    cuts = sorted([*((int(a), int(b)) for a, b in edges.reshape(-1, 2)), *((int(r), int(r) + 1) for r in np.flatnonzero(kind >= 3))])
    for a, b in cuts:
        above = x[a - 1] if a else np.zeros(x.shape[1], np.uint8)
        if kind[a] == 2:
            x[a:b] = np.cumsum(np.vstack([above[None], x[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind[a] <= 4:
            x[a] = _predicted(x[a].tolist(), above.tolist(), int(kind[a]))
        else:
            raise ValueError("unknown row filter")
    return x


def _predicted(line: list[int], above: list[int], kind: int) -> list[int]:
    """A row filtered by average (3) or by the nearest of left, above and corner (4)."""
    left = corner = 0
    for i, up in enumerate(above):
        if kind == 3:
            guess = (left + up) // 2
        else:
            by_left, by_up, by_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if by_left <= by_up and by_left <= by_corner else up if by_up <= by_corner else corner
        line[i] = left = (line[i] + guess) & 255
        corner = up
    return line


def decode(image: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG, (rows, width)."""
    head, parts, ended = None, [], False
    for kind, data in chunks(image):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        ended = ended or kind == b"IEND"
    if head is None or not ended or head[2:] != (8, GREY, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale PNG without interlace")
    inflate = zlib.decompressobj()
    raw = b"".join([*(inflate.decompress(p) for p in parts), inflate.flush()])
    if len(raw) != head[1] * (head[0] + 1) or not inflate.eof:
        raise ValueError("the image data has another size")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int, at: np.ndarray, count: int = 8) -> np.ndarray:
    return np.rint(1024 * np.cos(np.pi * (2 * at[:, None] + 1) * np.arange(count) / (2 * n)))


def cosine_hash(samples: np.ndarray, block: int = 1 << 14) -> str:
    """64 bits in hexadecimal: which of the 8 x 8 lowest frequencies lie above their median.

    Products and sums of a block stay below 2**53, so float arithmetic on them is exact.
    """
    rows, width = samples.shape
    across = _cosines(width, np.arange(width))
    total = np.zeros((8, 8), object)
    for a in range(0, rows, block):
        part = samples[a : a + block].astype(np.float64) @ across
        total += (_cosines(rows, np.arange(a, min(rows, a + block))).T @ part).astype(np.int64).astype(object)
    flat = [int(v) for v in total.ravel()]
    middle = sorted(flat)[len(flat) // 2]
    return f"{sum((v > middle) << k for k, v in enumerate(flat)):016x}"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):  # images of a few rows at a time
            part = b.slice(at, 256)
            raws = [x or b"" for x in part.column(1).to_pylist()]
            yield pa.record_batch({"id": part.column(0), "n_bytes": pa.array([len(x) for x in raws], pa.int64()), "media": pa.array([encode(pad(x)) for x in raws], pa.binary())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for b in batches:
        out: dict[str, list] = {k: [] for k in names}
        for image in b.column(2).to_pylist():
            row = [None] * len(names)
            if image is not None:
                row[3:5] = len(image), hashlib.sha256(image).hexdigest()
                try:
                    samples = decode(image)
                except (ValueError, zlib.error):
                    samples = None
                if samples is not None and samples.size:
                    payload = samples.tobytes()
                    row[:3] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
                    row[5] = cosine_hash(samples)
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        yield pa.record_batch({"id": b.column(0), "n_bytes": b.column(1), **{k: pa.array(v, pa.string() if isinstance(next((x for x in v if x is not None), None), str) or k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k, v in out.items()}})


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded, as a PNG in a binary column."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(_encoded, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def read_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Features of the images of (id, n_bytes, media), from the stored bytes alone."""
    return media.mapInArrow(_read, f"id {dict(media.dtypes)['id']}, n_bytes long, {FEATURES}").withColumnRenamed("id", id_col)
