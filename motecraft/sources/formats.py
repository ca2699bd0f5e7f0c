"""What Spark's image source leaves out of files: frames, orientation marks, and grey images of 16 bits.

Only tables of chunks and tags are read here, and the samples of 16-bit grey PNG files; other decoding is Spark's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = "frames int, orientation int, deep boolean"
#: The beginning of PNG files, the tag of orientation, and the sizes of the integers it may be.
PNG, ORIENTATION, SHORT, LONG = b"\x89PNG\r\n\x1a\n", 0x0112, 3, 4


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Names and contents of a PNG file's chunks, as far as they are whole."""
    at = len(PNG)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def tiff_directories(data: bytes) -> Iterator[dict[int, int]]:
    """Short and long single values by tag of each directory of a TIFF file; a chain that bites its tail ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        if at + 2 + 12 * n > len(data):
            return
        found = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if count == 1 and kind in (SHORT, LONG):
                found[tag] = struct.unpack_from(order + ("H" if kind == SHORT else "I"), data, at + 10 + 12 * k)[0]
        yield found
        end = at + 2 + 12 * n
        at = struct.unpack_from(order + "I", data, end)[0] if end + 4 <= len(data) else 0


def jpeg_exif(data: bytes) -> bytes:
    """The EXIF block of a JPEG file, or nothing."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def facts(data: bytes | None) -> tuple[int, int, bool]:
    """Frames, orientation (1 to 8) and whether it is 16-bit grey, of one file; 1, 1 and false where nothing is marked."""
    frames, exif, deep = 1, b"", False
    if data is None:
        return 1, 1, False
    if data.startswith(PNG):
        for name, body in png_chunks(data):
            if name == b"IHDR" and len(body) == 13:
                deep = body[8] == 16 and body[9] in (0, 4)
            elif name == b"acTL" and len(body) >= 4:
                frames = int.from_bytes(body[:4], "big")
            elif name == b"eXIf":
                exif = body
    elif data[:2] in (b"II", b"MM"):
        frames, exif = max(1, sum(1 for _ in tiff_directories(data))), data
    elif data[:3] == b"\xff\xd8\xff":
        exif = jpeg_exif(data)
    orientation = next(tiff_directories(exif), {}).get(ORIENTATION, 1)
    return frames, orientation if 1 <= orientation <= 8 else 1, deep


def grey_bytes(data: bytes) -> np.ndarray | None:
    """The high bytes of a 16-bit grey PNG file's samples; None if it is interlaced or broken."""
    head, packed = b"", b""
    parts = []
    for name, body in png_chunks(data):
        if name == b"IHDR":
            head = body
        elif name == b"IDAT":
            parts.append(body)
    packed = b"".join(parts)
    if len(head) != 13 or head[12]:
        return None
    width, height = struct.unpack(">II", head[:8])
    step = 2 if head[9] == 0 else 4
    try:
        flat = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error:
        return None
    if flat.size != height * (1 + width * step) or not flat.size:
        return None
    lines = flat.reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    for y in range(height):
        out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y - 1] if y else np.zeros(width * step, np.uint8), step)
    return out.reshape(height, width, step)[:, :, 0]


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    if kind == 1:  # left: sums along the line
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:  # up
        return line + up
    if kind in (3, 4):  # each byte needs the one before it
        over, got = up.tolist(), line.tolist()
        for i, v in enumerate(got):
            a, b = (got[i - step], over[i]) if i >= step else (0, over[i])
            if kind == 3:
                got[i] = (v + (a + b) // 2) & 255
            else:
                c = over[i - step] if i >= step else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
                got[i] = (v + near[2]) & 255
        return np.array(got, np.uint8)
    return line


def turned(image: np.ndarray, orientation: int) -> np.ndarray:
    """A picture as it is to be seen: 2 to 4 are mirrored or upside down, 5 to 8 lie on a side."""
    if orientation >= 5:
        image = image.swapaxes(0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return image


def facts_of(content: Column) -> Column:
    """`facts` of files' contents as a struct."""

    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([facts(v) for v in data], columns=["frames", "orientation", "deep"])

    return F.pandas_udf(run, FACTS)(content)


def grey_of(content: Column) -> Column:
    """`grey_bytes` of contents that aren't null, as a binary; null where it can't be read."""

    def run(data: pd.Series) -> pd.Series:
        made = (None if v is None else grey_bytes(v) for v in data)
        return pd.Series([None if m is None else m.tobytes() for m in made], dtype=object)

    return F.pandas_udf(run, "binary")(content)


def turned_of(data: Column, height: Column, width: Column, channels: Column, orientation: Column) -> Column:
    """Pixels turned by their orientation, where `data` isn't null."""

    def run(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series, orientation: pd.Series) -> pd.Series:
        rows = zip(data, height, width, channels, orientation, strict=True)
        return pd.Series([None if d is None else turned(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c)), int(o)).tobytes() for d, h, w, c, o in rows], dtype=object)

    return F.pandas_udf(run, "binary")(data, height, width, channels, orientation)
