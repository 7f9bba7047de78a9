"""Media columns: byte payloads as 8-bit greyscale PNG in a binary column, read back and hashed.

A text becomes its UTF-8 bytes, padded with 255 to a positive multiple of 576 and laid
out in rows of 576 samples. The PNG is split into length-tagged chunks with CRC-32, its
rows are filtered and zlib-compressed; each row takes the filter with the least sum of absolute differences of none, left and up.
Reading checks every CRC, the Adler sum and the sizes, and undoes all five row filters in numpy. The feature is a 64-bit hash: the image is averaged to
32 x 32, the 8 x 8 lowest frequencies of its cosine transform are compared with their median.

Defined results: a null or empty text is one row of 255; equal texts give equal bytes and
features; repeated rows give repeated results; an empty table gives an empty one; further
columns of the input are not read, so clashing names don't matter; very long texts are
one image each, held by one task alone.
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

from . import words

UNIT = 576
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_SIDE, _LOW = 32, 8
_k = np.arange(_SIDE)
_COSINE = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:, None] / (2 * _SIDE))[:_LOW]


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with bytes 255 up to a positive multiple of unit."""
    size = max(1, -(-len(raw) // unit)) * unit
    return raw + b"\xff" * (size - len(raw))


def encode_png(payload: bytes, width: int = UNIT, level: int = 4) -> bytes:
    """Rows of width samples, each with the filter that makes its samples smallest (none, left or up; ties in that order)."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    forms = np.stack([rows, rows, rows])
    forms[1, :, 1:] -= rows[:, :-1]
    forms[2, 1:] -= rows[:-1]
    kinds = np.minimum(forms, -forms).sum(axis=2, dtype=np.int64).argmin(axis=0)
    lines = np.empty((len(rows), width + 1), dtype=np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = forms[kinds, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def _wave(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo filters along anti-diagonals: left, upper and upper-left samples are known there."""
    h, w = lines.shape
    out = np.zeros((h + 1, w + 1), dtype=np.int32)
    for d in range(h + w - 1):
        r = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - r
        a, b, x = out[r + 1, c], out[r, c + 1], out[r, c]
        p = a + b - x
        pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - x)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, x))
        guess = np.choose(kinds[r], [np.zeros_like(a), a, b, (a + b) >> 1, paeth])
        out[r + 1, c + 1] = (lines[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height, width) of an 8-bit greyscale PNG; ValueError if anything doesn't hold."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("chunk cut short")
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r}: checksum differs")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG without interlace")
    w, h = head[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != h * (w + 1):
        raise ValueError("samples missing")
    lines = raw.reshape(h, w + 1)
    kinds, lines = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    if not kinds.any():
        return lines
    if (kinds > 2).any():
        return _wave(kinds, lines)
    out = lines.copy()
    left = kinds == 1
    out[left] = np.cumsum(lines[left], axis=1, dtype=np.uint8)
    for r in np.flatnonzero(kinds[1:] == 2) + 1:
        out[r] += out[r - 1]
    return out


def _shrink(x: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis]
    at = np.arange(_SIDE) * n // _SIDE
    size = np.maximum(np.diff(np.append(at, n)), 1)
    return np.add.reduceat(x, at, axis=axis) / (size[:, None] if axis == 0 else size[None, :])


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: signs of the 8 x 8 lowest frequencies against the median of all but the mean."""
    small = _shrink(_shrink(image.astype(np.float64), 0), 1)
    low = (_COSINE @ small @ _COSINE.T).ravel()
    low = np.round(low, 6)
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG in a binary column."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = words.utf8(batch.column(1))
            for i, j in words.spans(bounds):
                media = [encode_png(pad(data[bounds[k] : bounds[k + 1]].tobytes())) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(bounds[i : j + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Reads each image of to_media back: payload facts, facts of the stored form and the feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                image = decode_png(media)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), image.shape[1], image.shape[0], cosine_hash(image)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, feature string")


def op10_media(spark, sf_dir: str) -> DataFrame:
    return media_features(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
