"""Media columns: payloads as PNG images in binary columns, and perceptual hashes of them.

A payload's bytes become the samples of an 8-bit grey image of fixed width.  The
image is written as PNG (signature, IHDR, IDAT and IEND chunks with checksums,
rows filtered, zlib) and read back with every checksum tested and the filters
undone in numpy.  The feature tells which of the 8 by 8 lowest frequencies of the
discrete cosine transform of the shrunken image exceed their median, the mean left
out.

Nulls and ties: a null text counts as empty; its payload is one row of padding.
Equal payloads give equal bytes and features, so repeated rows get equal results.
Bytes that are no valid PNG give an error text, not a failed task.  Columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vellumix.session import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, UNIT, PAD = 64, 576, 255
_SIDE, _LOW = 32, 8
_LEVEL = 1


def payload_of(text: bytes) -> bytes:
    """The text followed by bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit grey PNG of a (height, width) array; each row takes the filter (none, sub or up) of least absolute sum."""
    h, w = pixels.shape
    sub, up = pixels.copy(), pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up[1:] -= pixels[:-1]
    tried = np.stack([pixels, sub, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(2)
    best = cost.argmin(0)
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = tried[best, np.arange(h)]
    header = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), _LEVEL)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of every chunk, each checksum tested."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("cut-off chunk")
        (size,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(png):
            raise ValueError("cut-off chunk")
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"wrong checksum of {kind!r}")
        yield kind, body
        at += 12 + size


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters; step is the bytes of a pixel."""
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    lo = 0
    while lo < len(rows):
        kind = kinds[lo]
        hi = lo + 1
        while hi < len(rows) and kinds[hi] == kind:
            hi += 1
        part = rows[lo:hi]
        if kind == 0:
            out[lo:hi] = part
        elif kind == 1:
            out[lo:hi] = np.cumsum(part.reshape(hi - lo, -1, step), axis=1, dtype=np.uint8).reshape(hi - lo, -1)
        elif kind == 2:
            out[lo:hi] = np.cumsum(np.vstack([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for i in range(lo, hi):
                line, b = rows[i].astype(int), (out[i - 1] if i else above).astype(int)
                for x in range(len(line)):
                    left, corner = (line[x - step], b[x - step]) if x >= step else (0, 0)
                    if kind == 3:
                        guess = (left + b[x]) // 2
                    else:
                        pa_, pb, pc = abs(b[x] - corner), abs(left - corner), abs(left + b[x] - 2 * corner)
                        guess = left if pa_ <= pb and pa_ <= pc else b[x] if pb <= pc else corner
                    line[x] = (line[x] + guess) & 255
                out[i] = line
        else:
            raise ValueError(f"unknown filter {kind}")
        above = out[hi - 1]
        lo = hi
    return out


def decode_png(png: bytes) -> np.ndarray:
    """The (height, width * channels) samples of an 8-bit, not interlaced PNG."""
    header, packed, ended = None, [], False
    for kind, body in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended:
        raise ValueError("no IHDR or IEND")
    w, h, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit samples without interlace or palette")
    line = w * channels + 1
    unpacker = zlib.decompressobj()
    raw = unpacker.decompress(b"".join(packed), h * line + 1)
    if len(raw) != h * line:
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, np.uint8).reshape(h, line)
    return _unfilter(rows[:, 0], rows[:, 1:], channels)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(_LOW)[:, None], np.arange(_SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * _SIDE))


def _shrink(values: np.ndarray, side: int) -> np.ndarray:
    """Means over `side` equal parts of the first axis; short arrays repeat entries."""
    cuts = np.arange(side) * len(values) // side
    ends = np.maximum((np.arange(side) + 1) * len(values) // side, cuts + 1)
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return (sums[ends] - sums[cuts]) / (ends - cuts).reshape(-1, *[1] * (values.ndim - 1))


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which of the square of low-frequency coefficients exceed the median of all but the mean; the mean's bit is 0."""
    small = _shrink(_shrink(pixels.astype(float), _SIDE).T, _SIDE).T
    low = np.round((_cosines() @ small @ _cosines().T).ravel(), 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        texts = batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py() or b""
            sizes.append(len(text))
            media.append(encode_png(np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (PNG bytes), a row for each row of docs."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


_FEATURES = [("payload", pa.binary()), ("feature", pa.binary()), ("error", pa.string())]


_DIGESTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _read_one(png: bytes) -> tuple[bytes | None, bytes | None, str | None]:
    """Payload, feature and error of one stored image."""
    try:
        pixels = decode_png(png)
        return pixels.tobytes(), cosine_hash(pixels), None
    except (ValueError, zlib.error, struct.error) as broken:
        return None, None, str(broken)


def _digest_one(png: bytes) -> tuple:
    payload, feature, _ = _read_one(png)
    own = (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) if payload is not None else (None, None, None)
    return *own, len(png), sha256(png).hexdigest(), None if feature is None else feature.hex()


def _read(digests: bool):
    kinds, one = (_DIGESTS, _digest_one) if digests else (_FEATURES, _read_one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column("media")
            rows = [one(media[i].as_py() or b"") for i in range(batch.num_rows)]
            kept = [c for c in batch.schema.names if c != "media" or not digests]
            arrays = [batch.column(c) for c in kept] + [pa.array([row[k] for row in rows], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[name for name, _ in kinds]])

    return run


def read(stored: DataFrame) -> DataFrame:
    """The stored rows with payload, feature (binary) and error read back from media."""
    ship(stored.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
    return stored.mapInArrow(_read(False), f"{kinds}, payload binary, feature binary, error string")


def read_digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digests of what read() returns, without moving the payloads out of the worker."""
    ship(stored.sparkSession)
    kind = stored.schema["doc_id"].dataType.simpleString()
    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read(True), f"doc_id {kind}, n_bytes long, {columns}")
