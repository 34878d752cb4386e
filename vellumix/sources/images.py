"""Facts from image headers: kind, size, density, animation; and setting a JPEG's density."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumix.session import ship

_FRAMES = frozenset([*range(0xC0, 0xC4), *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)])


def kind_of(b: bytes) -> str | None:
    if b[:3] == b"\xff\xd8\xff":
        return "jpg"
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if b[:4] in (b"II*\0", b"MM\0*"):
        return "tif"
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return "webp"
    if b[:2] == b"BM":
        return "bmp"
    if b[40:44] == b" EMF" and b[:4] == b"\x01\0\0\0":
        return "emf"
    return "svg" if b.lstrip()[:4].lower() == b"<svg" or b"<svg" in b[:512].lower() and b.lstrip()[:1] == b"<" else None


def _segments(b: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start of body, end) of a JPEG's segments up to its image data."""
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            at += 2
            continue
        (size,) = struct.unpack_from(">H", b, at + 2)
        yield marker, at + 4, at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


def facts(b: bytes) -> tuple[str | None, int | None, int | None, float | None, bool]:
    """kind, width, height, dots per inch and whether there are several frames."""
    kind, w, h, dpi, frames = kind_of(b), None, None, None, 1
    try:
        if kind == "jpg":
            for marker, lo, hi in _segments(b):
                if marker == 0xE0 and b[lo : lo + 5] == b"JFIF\0" and hi - lo >= 12:
                    unit, x = b[lo + 7], struct.unpack_from(">H", b, lo + 8)[0]
                    dpi = float(x) if unit == 1 and x else x * 2.54 if unit == 2 and x else dpi
                elif marker in _FRAMES:
                    h, w = struct.unpack_from(">HH", b, lo + 1)
        elif kind == "png":
            w, h = struct.unpack_from(">II", b, 16)
        elif kind == "gif":
            w, h = struct.unpack_from("<HH", b, 6)
            frames = _gif_frames(b)
        elif kind == "bmp":
            w, h = struct.unpack_from("<ii", b, 18)
            h = abs(h)
    except (struct.error, IndexError):
        pass
    return kind, w, h, dpi, frames > 1


def _gif_frames(b: bytes) -> int:
    at, n = 13 + (3 << ((b[10] & 7) + 1) if b[10] & 0x80 else 0), 0
    while at < len(b) and b[at] != 0x3B:
        if b[at] == 0x2C:
            n += 1
            flags = b[at + 9]
            at += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        elif b[at] == 0x21:
            at += 2
        else:
            break
        while at < len(b) and b[at]:
            at += b[at] + 1
        at += 1
    return n


def with_density(b: bytes, dpi: int) -> bytes:
    """A JPEG whose JFIF header says dpi; the header is put in where there is none."""
    if kind_of(b) != "jpg":
        return b
    density = struct.pack(">BHH", 1, dpi, dpi)
    for marker, lo, hi in _segments(b):
        if marker == 0xE0 and b[lo : lo + 5] == b"JFIF\0" and hi - lo >= 12:
            return b[: lo + 7] + density + b[lo + 12 :]
    return b[:2] + b"\xff\xe0\x00\x10JFIF\x00\x01\x01" + density + b"\x00\x00" + b[2:]


def read_images(files: DataFrame) -> DataFrame:
    """path, kind, width, height, dpi and animated of binary files."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = [facts(c.as_py() or b"") for c in batch.column("content")]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["path", "kind", "width", "height", "dpi", "animated"])

    return files.select("path", "content").mapInArrow(run, "path string, kind string, width int, height int, dpi double, animated boolean")
