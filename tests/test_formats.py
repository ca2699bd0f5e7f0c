"""Frames, orientation marks and 16-bit grey of files that are written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from motecraft.sources import formats, images, sinks

PLANE = np.arange(30, dtype=np.uint8).reshape(5, 6) * 7


def chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def deep_png(samples: np.ndarray, alpha: bool = False, interlaced: int = 0) -> bytes:
    """A 16-bit grey file that uses the five filters in turn."""
    h, w = samples.shape
    wide = samples.astype(">u2")
    if alpha:
        wide = np.stack((wide, np.full_like(wide, 65535)), axis=2).astype(">u2")
    step = 4 if alpha else 2
    raw = np.frombuffer(wide.tobytes(), np.uint8).reshape(h, w * step).astype(int)
    lines = []
    for y in range(h):
        line, up, kind = raw[y], raw[y - 1] if y else np.zeros(w * step, int), y % 5
        left, corner = np.concatenate((np.zeros(step, int), line[:-step])), np.concatenate((np.zeros(step, int), up[:-step]))
        p = left + up - corner
        far = np.stack((abs(p - left), abs(p - up), abs(p - corner)))
        paeth = np.choose(far.argmin(axis=0), (left, up, corner))
        guess = (np.zeros_like(line), left, up, (left + up) // 2, paeth)[kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", w, h, 16, 4 if alpha else 0, 0, 0, interlaced)
    return formats.PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def directory(order: str, orientation: int, following: int = 0) -> bytes:
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, orientation, 0) + struct.pack(order + "I", following)


def test_sixteen_bits_decode_to_their_high_byte():
    samples = np.random.default_rng(1).integers(0, 65536, (11, 7))
    for alpha in (False, True):
        data = deep_png(samples, alpha)
        assert formats.facts(data) == (1, 1, True) and np.array_equal(formats.grey_bytes(data), samples >> 8)
    assert formats.grey_bytes(deep_png(samples, interlaced=1)) is None and formats.grey_bytes(deep_png(samples)[:60]) is None


def test_frames_and_marks():
    assert formats.facts(None) == formats.facts(b"") == formats.facts(b"\x89PNG") == formats.facts(b"II*\0") == (1, 1, False)
    png = sinks.png(np.repeat(PLANE[:, :, None], 3, axis=2))
    assert formats.facts(png) == (1, 1, False)
    assert formats.facts(png[:33] + chunk(b"acTL", struct.pack(">II", 3, 0)) + png[33:])[0] == 3
    for order in "<>":
        for k in range(1, 9):
            exif = directory(order, k)
            jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif + b"\xff\xda"
            assert formats.facts(exif) == formats.facts(jpeg) == formats.facts(png[:33] + chunk(b"eXIf", exif) + png[33:]) == (1, k, False)
    two = directory("<", 1, 26)
    assert formats.facts(two + two[8:22] + struct.pack("<I", 0))[0] == 2
    assert formats.facts(directory("<", 9)) == (1, 1, False) and formats.facts(directory("<", 1, 8))[0] == 1


def test_eight_orientations_are_one_picture():
    """How a camera stores the picture for each mark, by the rows and columns that the mark names."""
    stored = {1: PLANE, 2: PLANE[:, ::-1], 3: PLANE[::-1, ::-1], 4: PLANE[::-1], 5: PLANE.T, 6: np.rot90(PLANE), 7: np.rot90(PLANE, 2).T, 8: np.rot90(PLANE, -1)}
    for mark, image in stored.items():
        assert np.array_equal(formats.turned(image, mark), PLANE), mark


def test_files_are_decoded_as_they_are_to_be_seen(spark, tmp_path):
    colour = np.stack((PLANE, PLANE + 1, PLANE + 2), axis=2)
    png = sinks.png(np.ascontiguousarray(np.rot90(colour)))
    (tmp_path / "turned.png").write_bytes(png[:33] + chunk(b"eXIf", directory(">", 6)) + png[33:])
    samples = np.arange(30).reshape(5, 6) * 2000
    (tmp_path / "deep.png").write_bytes(deep_png(samples))
    (tmp_path / "plain.png").write_bytes(sinks.png(colour))
    (tmp_path / "moving.png").write_bytes(png[:33] + chunk(b"acTL", struct.pack(">II", 2, 0)) + png[33:])
    rows = {r["name"]: r for r in images.decoded(spark, str(tmp_path), images.checked(images.scan(spark, str(tmp_path)))).collect()}
    for name in ("turned.png", "plain.png"):
        assert (rows[name]["error"], rows[name]["width"], rows[name]["height"]) == (None, 6, 5) and bytes(rows[name]["data"]) == colour.tobytes()
    assert rows["deep.png"]["n_channels"] == 1 and bytes(rows["deep.png"]["data"]) == (samples >> 8).astype(np.uint8).tobytes()
    assert rows["moving.png"]["error"] == "several frames"


@pytest.mark.parametrize("cut", [0, 20, 40, 57])
def test_cut_files_do_not_stop_a_batch(cut):
    assert formats.facts(deep_png(np.zeros((3, 3), int))[:cut])[0] == 1
