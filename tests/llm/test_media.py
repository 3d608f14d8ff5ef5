import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from digestry.llm import media


def filtered(samples, kinds):
    """PNG of samples with a given filter for each row, by the definition, sample by sample."""
    raw = bytearray()
    height, width = samples.shape
    at = lambda y, x: int(samples[y, x]) if y >= 0 and x >= 0 else 0
    for y in range(height):
        raw.append(kinds[y])
        for x in range(width):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            raw.append((at(y, x) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    packed = zlib.compress(bytes(raw))
    return (media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"a\0b")
            + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b""))


@pytest.mark.parametrize("seed", range(12))
def test_every_filter_is_undone(seed):
    random.seed(seed)
    samples = np.random.default_rng(seed).integers(0, 256, (random.randint(1, 12), random.randint(1, 9)), dtype=np.uint8)
    kinds = [random.randrange(5) if seed else 4 for _ in samples]
    assert (media.decode_png(filtered(samples, kinds)) == samples).all()
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_smooth_images_choose_a_filter():
    slope = np.add.outer(np.arange(64, dtype=np.uint8), np.arange(64, dtype=np.uint8) * 3)
    assert len(media.encode_png(slope)) < 400 and (media.decode_png(media.encode_png(slope)) == slope).all()


def test_broken_images_are_told():
    good = media.encode_png(np.arange(256, dtype=np.uint8).reshape(4, 64))
    for i in range(len(good)):
        with pytest.raises(media.MediaError):
            media.decode_png(good[:i] + bytes([good[i] ^ 1]) + good[i + 1:])
        with pytest.raises(media.MediaError):
            media.decode_png(good[:i])


def test_cosine_hash_by_definition():
    samples = np.random.default_rng(1).integers(0, 256, (32, 32), dtype=np.uint8)
    n, low = 32, []
    for u in range(8):
        for v in range(8):
            low.append(sum(float(samples[y, x]) * np.cos(np.pi / n * u * (y + .5)) * np.cos(np.pi / n * v * (x + .5)) for y in range(n) for x in range(n)))
    bits = [x > np.median(low[1:]) for x in low]
    assert media.appearance(samples) == np.packbits(bits).tobytes()
    bright = np.clip(samples.astype(int) // 2 + 10, 0, 255).astype(np.uint8)
    differing = np.unpackbits(np.frombuffer(media.appearance(samples), np.uint8) ^ np.frombuffer(media.appearance(bright), np.uint8)).sum()
    assert differing <= 6


def test_texts_round_trip(spark):
    texts = ["", None, "a", "é" * 32, "x" * 64, "y" * 65, "long " * 40_000, "a", "\0\0"]
    rows = spark.createDataFrame([(i, t, "m", "p") for i, t in enumerate(texts)], "doc_id long, text string, media string, payload string")
    stored = media.to_png(rows)
    assert stored.columns == ["doc_id", "text", "payload", "media", "n_bytes"]
    got = {r.doc_id: r for r in media.from_png(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert bytes(got[i].payload) == padded and got[i].n_bytes == len(raw) and got[i].error is None and len(got[i].feature) == 8
    assert got[2].media_sha256 == got[7].media_sha256 and got[0].feature == got[1].feature
    pngs = {r.doc_id: bytes(r.media) for r in stored.collect()}
    assert all(got[i].media_sha256 == hashlib.sha256(p).hexdigest() and got[i].media_bytes == len(p) for i, p in pngs.items())


def test_bad_rows_and_empty_tables(spark):
    bad = spark.createDataFrame([(1, None), (2, b"no image")], "doc_id long, media binary")
    assert [(r.doc_id, r.payload, r.feature, r.error is not None) for r in media.from_png(bad).orderBy("doc_id").collect()] == [(1, None, None, True), (2, None, None, True)]
    assert media.from_png(media.to_png(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
