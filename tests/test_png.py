"""Pictures whose end is missing."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from conftest import png

from tilequery.functions.png import rows_that_arrived
from tilequery.sources import images

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def predicted(kind, row, up, i, c):
    left, above, corner = (int(row[i - 1, c]) if i else 0), int(up[i, c]), (int(up[i - 1, c]) if i else 0)
    if kind == 4:
        p = left + above - corner
        return min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
    return {0: 0, 1: left, 2: above, 3: (left + above) // 2}[kind]


def encoded(img, colour, kinds, palette=None) -> bytes:
    h, w, ch = img.shape
    raw, up = b"", np.zeros((w, ch), np.uint8)
    for y in range(h):
        kind = kinds[y % len(kinds)]
        raw += bytes([kind]) + bytes((int(img[y, i, c]) - predicted(kind, img[y], up, i, c)) & 255 for i in range(w) for c in range(ch))
        up = img[y]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(raw, 0)  # stored: half the bytes are half the rows
    parts = b"".join(chunk(b"IDAT", body[k : k + 300]) for k in range(0, len(body), 300))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    return b"\x89PNG\r\n\x1a\n" + head + parts + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 3, 4, 6])
def test_rows_that_arrived(colour):
    rng = np.random.default_rng(colour)
    palette = rng.integers(0, 256, (20, 3)).astype(np.uint8) if colour == 3 else None
    img = rng.integers(0, 20 if colour == 3 else 256, (24, 17, CHANNELS[colour])).astype(np.uint8)
    rgb = palette[img[:, :, 0]] if colour == 3 else np.repeat(img[:, :, :1], 3, axis=2) if colour in (0, 4) else img[:, :, :3]
    data = encoded(img, colour, [0, 1, 2, 3, 4], palette)
    assert rows_that_arrived(data) == (24, 17, rgb.tobytes(), 24)
    for share in (0.9, 0.5, 0.2):
        h, w, px, n = rows_that_arrived(data[: int(len(data) * share)])
        got = np.frombuffer(px, np.uint8).reshape(24, 17, 3)
        assert (h, w) == (24, 17) and 24 * share - 6 < n < 24 * share + 1
        assert (got[:n] == rgb[:n]).all() and not got[n:].any()


def test_what_is_no_picture():
    good = encoded(np.zeros((2, 2, 3), np.uint8), 2, [0])
    for bad in (None, b"", b"GIF89a", good[:20], good[:8] + good[33:]):
        assert rows_that_arrived(bad) is None
    assert rows_that_arrived(good[:33])[3] == 0
    assert rows_that_arrived(good.replace(b"IDAT\x78", b"IDAT\x00"))[3] == 0


def test_truncated_files_are_loaded(spark, tmp_path):
    rng = np.random.default_rng(3)
    img = rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    png(tmp_path / "whole.png", img)
    data = (tmp_path / "whole.png").read_bytes()
    (tmp_path / "half.png").write_bytes(data[: len(data) // 2])
    (tmp_path / "none.png").write_bytes(b"no picture")
    got = {r["filepath"]: r for r in images.load_images(spark, str(tmp_path), truncated=True).collect()}
    assert set(got) == {"whole.png", "half.png", "none.png"}
    assert got["whole.png"]["pixels"] == img.tobytes() and got["none.png"]["pixels"] is None
    half = np.frombuffer(got["half.png"]["pixels"], np.uint8).reshape(16, 16, 3)
    n = int((half == img).all((1, 2)).sum())
    assert (got["half.png"]["h"], got["half.png"]["w"]) == (16, 16) and 4 <= n < 16 and (half[:n] == img[:n]).all() and not half[n:].any()
    assert images.load_images(spark, str(tmp_path), truncated=True, drop_invalid=True).count() == 2
    assert images.load_images(spark, str(tmp_path)).filter("pixels is null").count() == 2
