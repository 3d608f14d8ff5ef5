"""Bytes kept losslessly as grey PNG images in a binary column, read back with tests, and hashed by appearance.

Encoding and decoding follow the PNG specification: length, type, data and CRC-32 of each chunk, one filter byte
before each row of samples, zlib around all rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WIDTH = 64
LEVEL = 3
SIDE, LOW = 32, 8  # picture of 32 x 32 means, its 8 x 8 lowest frequencies

SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """Stored bytes that are no grey 8-bit PNG or fail a checksum."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = LEVEL) -> bytes:
    """Grey 8-bit PNG of a (height, width) array; of none, left and upper neighbour, the filter of least residue is used."""
    height, width = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    choices = {NONE: samples, SUB: left, UP: above}
    # Text repeats itself, so raw rows win unless a filter leaves much smaller numbers.
    weight = {k: int(np.abs(v.view(np.int8).astype(np.int16)).sum()) for k, v in choices.items()}
    best = min((SUB, UP), key=weight.__getitem__)
    kind = best if 4 * weight[best] < weight[NONE] else NONE
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, choices[kind]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)),
                     _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)), _chunk(b"IEND", b"")])


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows. Runs of rows of one filter are undone together where the filter allows it."""
    out = np.empty_like(rows)
    height, width = rows.shape
    bounds = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *bounds], [*bounds, height]):
        before = out[a - 1] if a else np.zeros(width, np.uint8)
        kind = kinds[a]
        if kind == NONE:
            out[a:b] = rows[a:b]
        elif kind == SUB:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += before
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                up, line = (out[y - 1] if y else before).tolist(), rows[y].tolist()
                left = corner = 0
                for x in range(width):
                    if kind == AVERAGE:
                        guess = (left + up[x]) >> 1
                    else:
                        p = left + up[x] - corner
                        guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                    left, corner = (line[x] + guess) & 255, up[x]
                    line[x] = left
                out[y] = line
        else:
            raise MediaError(f"unknown filter {kind}")
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG without interlace; every chunk's checksum and every length is tested."""
    if stored[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, size, parts, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise MediaError("cut off")
        n = int.from_bytes(stored[at:at + 4], "big")
        kind, data, crc = stored[at + 4:at + 8], stored[at + 8:at + 8 + n], stored[at + 8 + n:at + 12 + n]
        if len(crc) < 4 or zlib.crc32(data, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", data)
            if (depth, colour, rest) != (8, 0, [0, 0, 0]) or not width or not height:
                raise MediaError("only grey images of 8 bits without interlace are kept here")
            size = height, width
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
        elif kind[:1].isupper():
            raise MediaError(f"unknown chunk {kind!r}")
        at += 12 + n
    if size is None or not ended:
        raise MediaError("a chunk is missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    height, width = size
    if len(raw) != height * (width + 1):
        raise MediaError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * np.outer(np.arange(k), np.arange(n) + 0.5))


def _means(samples: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Means of n equal stretches along an axis; a sample on a border counts to both by its share."""
    size = samples.shape[axis]
    sums = np.insert(np.cumsum(samples, axis=axis, dtype=np.float64), 0, 0, axis=axis)
    edges = np.arange(n + 1) * size / n
    low = np.minimum(edges.astype(np.int64), size - 1)
    a, b = np.take(sums, low, axis), np.take(sums, low + 1, axis)
    share = np.expand_dims(edges - low, 1 - axis)
    return np.diff(a + (b - a) * share, axis=axis) * (n / size)


def appearance(samples: np.ndarray) -> bytes:
    """Eight bytes: which of the lowest frequencies of the cosine transform exceed their median."""
    small = _means(_means(samples, 0, SIDE), 1, SIDE)
    waves = _cosines(SIDE, LOW)
    low = np.round((waves @ small @ waves.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes()


def _padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def to_png(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Adds the text's bytes as a PNG of 64 samples a row, filled up with zeros, and their number.

    Null counts as empty, and an empty text becomes one row of zeros. All other columns stay; columns named like
    the two new ones are replaced. Rows are worked on one by one, so memory follows the longest text.
    """
    kept = docs.drop(media, n_bytes).withColumn("__bytes", F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__bytes")
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raw = part.column(at).to_pylist()
                images = [encode_png(np.frombuffer(_padded(x), np.uint8).reshape(-1, WIDTH)) for x in raw]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(images, pa.binary()), pa.array(map(len, raw), pa.int64())],
                                                 names=[*part.schema.names[:at], media, n_bytes])

    schema = StructType([f for f in kept.schema.fields if f.name != "__bytes"]).add(media, "binary").add(n_bytes, "long")
    return kept.mapInArrow(encode, schema)


def from_png(images: DataFrame, media: str = "media") -> DataFrame:
    """Replaces the PNG column by what is read back: `payload`, `feature` (eight bytes) and `error` (null if sound).

    A null or broken image has null payload and feature, and its error names the test that failed. The stored form's
    length and SHA-256 are given as `media_bytes` and `media_sha256`.
    """
    kept = images.drop("payload", "feature", "error", "media_bytes", "media_sha256")
    kept = kept.select(*(c for c in kept.columns if c != media), F.octet_length(media).cast("long").alias("media_bytes"),
                       F.sha2(media, 256).alias("media_sha256"), F.col(media).alias("__media"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__media")
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                payloads, features, errors = [], [], []
                for stored in part.column(at).to_pylist():
                    try:
                        if stored is None:
                            raise MediaError("no image")
                        samples = decode_png(stored)
                        found = samples.tobytes(), appearance(samples), None
                    except MediaError as e:
                        found = None, None, str(e)
                    for column, value in zip((payloads, features, errors), found):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at)), pa.array(payloads, pa.binary()), pa.array(features, pa.binary()),
                                                  pa.array(errors, pa.string())], names=[*part.schema.names[:at], "payload", "feature", "error"])

    schema = StructType([f for f in kept.schema.fields if f.name != "__media"]).add("payload", "binary").add("feature", "binary").add("error", "string")
    return kept.mapInArrow(decode, schema)
