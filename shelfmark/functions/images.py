"""Width, height and page count from the first bytes of an image."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as P

SIZE_TYPE = P.StructType([P.StructField(name, P.IntegerType()) for name in ("width", "height", "pages")])


def _gif_pages(data: bytes) -> int:
    """Image blocks of a GIF, by stepping over its blocks."""
    def table(flags: int) -> int:
        return 3 * (2 << (flags & 7)) if flags & 0x80 else 0

    at, pages = 13 + table(data[10]), 0
    while at < len(data):
        if data[at] == 0x3B:
            break
        if data[at] == 0x21:
            at += 2
        elif data[at] == 0x2C and at + 10 <= len(data):
            pages += 1
            at += 11 + table(data[at + 9])
        else:
            break
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return pages


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            # Any number of fill bytes may stand before a marker.
            at += 1
            continue
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _webp_pages(data: bytes) -> int:
    """Frames of a WebP, by stepping over its chunks, each padded to an even size."""
    at, pages = 12, 0
    while at + 8 <= len(data):
        pages += data[at : at + 4] == b"ANMF"
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + size % 2
    return pages


def _webp_size(data: bytes) -> tuple[int, int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        width = 1 + int.from_bytes(data[24:27], "little")
        height = 1 + int.from_bytes(data[27:30], "little")
        return width, height, max(1, _webp_pages(data)) if data[20] & 2 else 1
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1, 1
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF, 1
    return None


def image_size(data: bytes | None) -> tuple[int, int, int] | None:
    """(width, height, pages); zeros for a kind without known size; None for no image at all."""
    try:
        if data is None:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return (*struct.unpack(">II", data[16:24]), 1)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", data[6:10]), max(1, _gif_pages(data)))
        if data[:2] == b"\xff\xd8":
            return (*(_jpeg_size(data) or (0, 0)), 1)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp_size(data) or (0, 0, 1)
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return abs(width), abs(height), 1
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(SIZE_TYPE)
def probe_size(content: pd.Series) -> pd.DataFrame:
    rows = [image_size(data) or (None, None, None) for data in content]
    return pd.DataFrame(rows, columns=["width", "height", "pages"], dtype="Int32")
