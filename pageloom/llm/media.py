"""Media columns: payloads stored as grey-scale PNG, read back with checksum tests, and hashed.

A payload becomes an 8-bit grey image of ``WIDTH`` samples a row. Rows are filtered (none, left
difference or upward difference, whichever has the least sum of absolute values over the image)
and compressed with zlib; chunks carry their CRC. Reading checks the signature, every chunk's CRC,
the header, the size of the inflated data and the Adler checksum, then undoes any of the five
filters with numpy. The feature is a low-frequency cosine-transform hash: the whole image is shrunk to
24 x 24 by the mean of each part's area, transformed, and each of the 8 x 8 lowest coefficients gives
a bit, set where it exceeds the median of all but the first. Padding (the bytes 255 at the end, which no
text holds) takes the mean of the rest first, or its edge would outweigh the text. So what stands where
in a text counts, in proportion to its length.

Defined results: null texts count as empty and are stored as one row of padding; equal texts give
equal values; texts of any length are stored whole; repeated rows stay; an empty table gives an
empty result; columns of the names that are added are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, TILE, LOW, LEVEL = 576, 24, 8, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class CorruptMedia(ValueError):
    """The stored bytes fail a checksum or break the format."""


def payload_of(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are ``payload``, a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    forms = {0: rows, 1: left, 2: up}
    cost = {k: np.abs(v.view(np.int8).astype(np.int16)).sum(dtype=np.int64) for k, v in forms.items()}
    kind = min(cost, key=lambda k: (cost[k], k))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = kind, forms[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise CorruptMedia("signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise CorruptMedia("cut off")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body, crc = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise CorruptMedia(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            break
    else:
        raise CorruptMedia("no end")
    if at != len(png):
        raise CorruptMedia("bytes after the end")


def _predicted(a: int, b: int, c: int) -> int:
    p = a + b - c
    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Rows [height, 1 + width] with their filter numbers -> samples [height, width]."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise CorruptMedia("filter")
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts, cuts[1:], strict=False):  # runs of one filter
        if a == b:
            continue
        kind = kinds[a]
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for r in range(a, b):
                above = out[r - 1].astype(int) if r else np.zeros(out.shape[1], int)
                row, left, corner = out[r].astype(int), 0, 0
                for x in range(len(row)):
                    add = (left + above[x]) // 2 if kind == 3 else _predicted(left, above[x], corner)
                    left = row[x] = (row[x] + add) & 255
                    corner = above[x]
                out[r] = row
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Samples [height, width] of a grey 8-bit PNG; CorruptMedia if any test fails."""
    head, data = None, []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            if len(body) != 13:
                raise CorruptMedia("header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if not head or head[2:] != (8, 0, 0, 0, 0) or not head[0] or not head[1]:
        raise CorruptMedia("header")
    try:
        flat = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise CorruptMedia(str(e)) from e
    if len(flat) != head[1] * (head[0] + 1):
        raise CorruptMedia("size")
    return unfilter(np.frombuffer(flat, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))[:LOW]


BASIS = _cosines(TILE)


def shrunk(samples: np.ndarray, size: int = TILE) -> np.ndarray:
    """The image as size x size means of equal areas; rows and columns that an edge cuts count in part."""
    for _ in range(2):  # rows, then columns
        n = len(samples)
        sums = np.concatenate([np.zeros((1, samples.shape[1])), np.cumsum(samples, axis=0, dtype=np.float64)])
        edges = np.arange(size + 1) * n / size
        whole = np.minimum(edges.astype(np.int64), n - 1)
        at = sums[whole] + (edges - whole)[:, None] * (sums[whole + 1] - sums[whole])
        samples = (np.diff(at, axis=0) * size / n).T
    return samples


def levelled(samples: np.ndarray) -> np.ndarray:
    """The image with the bytes 255 at its end replaced by the mean of the others."""
    flat = samples.ravel()
    size = len(flat) - int(np.argmax(flat[::-1] != 255)) if (flat != 255).any() else 0
    if not size:
        return samples.astype(np.float64)
    return np.r_[flat[:size].astype(np.float64), np.full(len(flat) - size, flat[:size].mean())].reshape(samples.shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: which low-frequency coefficients of the levelled, shrunk image exceed their median."""
    low = (BASIS @ shrunk(levelled(samples)) @ BASIS.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def _mapped(df: DataFrame, run, added: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, {added}")


def store(docs: DataFrame, rows: int = 64) -> DataFrame:
    """``docs`` with n_bytes and media (binary: the PNG of each text's payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, len(whole)), rows):
                batch = whole.slice(at, rows)
                data = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]
                media = pa.array([encode_png(payload_of(d)) for d in data], pa.binary())
                yield _with(batch, {"n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": media})

    return _mapped(docs.drop("n_bytes", "media"), run, "n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """``stored`` with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and hash (8 bytes), read from media."""
    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash")

    def of(png: bytes) -> tuple:
        samples = decode_png(png)
        raw = samples.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        for batch in batches:
            found = list(zip(*(of(m.as_py()) for m in batch.column("media")), strict=True)) or [[]] * 6
            yield _with(batch, {n: pa.array(v, k) for n, v, k in zip(names, found, kinds, strict=True)})

    return _mapped(stored.drop(*names), run, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""
    stored = store(docs.select("doc_id", "text")).drop("text")
    return describe(stored).selectExpr(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "lower(hex(hash)) AS feature"
    )
