"""What a PNG file still holds when its end is missing: the rows that arrived, the rest black."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the file format
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # by colour type: grey, RGB, palette, grey and alpha, RGBA
_GREY, _PALETTE, _GREY_ALPHA = 0, 3, 4


def _chunks(data: bytes):
    """Kind and body of every chunk; the last body may be cut short."""
    at = len(_SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _inflated(parts: list[bytes]) -> bytes:
    """As much as can be inflated of a stream that may break off or go wrong."""
    stream, out = zlib.decompressobj(), []
    for part in parts:
        for at in range(0, len(part), 4096):
            try:
                out.append(stream.decompress(part[at : at + 4096]))
            except zlib.error:
                return b"".join(out)
    return b"".join(out)


def _nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours the one nearest to left + up - corner; ties in this order."""
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _plain_row(kind: int, row: np.ndarray, up: np.ndarray) -> np.ndarray:
    """A row (pixels x channels) from its differences to what lies before it."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0, dtype=np.uint8)
    if kind == 2:
        return row + up
    out, left, corner = np.empty_like(row), np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
    for i, (value, above) in enumerate(zip(row.astype(np.int64), up.astype(np.int64))):
        left = (value + ((left + above) // 2 if kind == 3 else _nearest(left, above, corner))) & 255
        out[i], corner = left, above
    return out


def rows_that_arrived(data: bytes | None) -> tuple[int, int, bytes, int] | None:
    """Height, width, RGB bytes (alpha dropped) and the number of rows that arrived; the others are black.

    None for what is no PNG, has no readable head, more or fewer than 8 bits a channel, or is interlaced.
    """
    if not data or not data.startswith(_SIGNATURE):
        return None
    head, palette, body = None, None, []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR" and len(chunk) == 13:
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk[: len(chunk) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6] or not head[0] or not head[1]:
        return None
    width, height, colour = head[0], head[1], head[3]
    if colour == _PALETTE and palette is None:
        return None
    channels = _CHANNELS[colour]
    raw = np.frombuffer(_inflated(body), np.uint8)
    stride = width * channels + 1
    arrived = min(height, len(raw) // stride)
    out = np.zeros((height, width, 3), np.uint8)
    up = np.zeros((width, channels), np.uint8)
    for y in range(arrived):
        row = raw[y * stride : (y + 1) * stride]
        if row[0] > 4:
            arrived = y
            break
        up = _plain_row(int(row[0]), row[1:].reshape(width, channels), up)
        if colour == _PALETTE:
            out[y] = palette[np.minimum(up[:, 0], len(palette) - 1)]
        else:
            out[y] = np.repeat(up[:, :1], 3, axis=1) if colour in (_GREY, _GREY_ALPHA) else up[:, :3]
    return height, width, out.tobytes(), arrived


_FOUND = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("rows", T.IntegerType())])


@F.pandas_udf(_FOUND)
def salvaged(content: pd.Series) -> pd.DataFrame:
    """The rows that arrived of each file (see :func:`rows_that_arrived`); all NULL where nothing can be read."""
    found = [rows_that_arrived(c) or (None, None, None, None) for c in content]
    h, w, px, n = zip(*found) if found else ((), (), (), ())
    return pd.DataFrame({"h": pd.array(h, "Int32"), "w": pd.array(w, "Int32"), "pixels": pd.Series(px, dtype=object), "rows": pd.array(n, "Int32")})
