import zlib
from hashlib import sha256

import numpy as np
import pytest

from tests.llm.helpers import frame, prose
from vellumix.llm import media


def test_round_trip_and_digests(spark):
    texts = [None, "", "é" * 288, "x" * 576, "x" * 577, prose(1, 4000), prose(1, 4000)]
    rows = media.read_digests(media.store(frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].media_sha256 == by_id[1].media_sha256 and by_id[5].feature == by_id[6].feature != by_id[3].feature
    full = media.read(media.store(frame(spark, texts))).collect()
    assert all(r.error is None and r.media[:8] == media.SIGNATURE and len(r.feature) == 8 for r in full)


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter_is_undone(kind):
    r = np.random.default_rng(kind)
    want = r.integers(0, 256, (6, 12), dtype=np.uint8)
    rows = np.empty_like(want)
    for y in range(6):
        for x in range(12):
            a = int(want[y, x - 3]) if x >= 3 else 0
            b = int(want[y - 1, x]) if y else 0
            c = int(want[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v)) if True else 0
            rows[y, x] = (int(want[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255
    assert (media._unfilter(np.full(6, kind), rows, 3) == want).all()


def test_broken_images_are_values(spark):
    png = media.encode_png(np.arange(256, dtype=np.uint8).reshape(4, 64))
    assert (media.decode_png(png).ravel() == np.arange(256)).all()
    spoilt = bytearray(png)
    spoilt[40] ^= 1
    for bad in (bytes(spoilt), png[:-3], b"", b"GIF89a", png.replace(b"IEND", b"IENX")):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bad)
    rows = spark.createDataFrame([(1, bytearray(spoilt)), (2, None), (3, bytearray(png))], "doc_id long, media binary")
    out = {r.doc_id: r for r in media.read(rows).collect()}
    assert "checksum" in out[1].error and out[2].error and out[3].error is None


def test_hash_is_low_frequency():
    r = np.random.default_rng(1)
    smooth = (128 + 100 * np.sin(np.linspace(0, 6, 64))[None, :] * np.cos(np.linspace(0, 4, 64))[:, None]).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + r.integers(-6, 7, smooth.shape), 0, 255).astype(np.uint8)
    other = r.integers(0, 256, smooth.shape, dtype=np.uint8)
    bits = lambda a, b: bin(int.from_bytes(media.cosine_hash(a), "big") ^ int.from_bytes(media.cosine_hash(b), "big")).count("1")
    assert bits(smooth, noisy) < 20 < bits(smooth, other) + 8


def test_empty_table(spark):
    assert media.read_digests(media.store(frame(spark, ["a"]).limit(0))).count() == 0
