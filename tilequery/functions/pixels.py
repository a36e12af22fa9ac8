"""Pixel work on image rows ``(h int, w int, pixels binary)``.

``pixels`` holds RGB bytes, rows top to bottom, channels interleaved. Every
function here is an Arrow-batched UDF applied to the columns of one row, so the
rows stay partitioned as the scan delivered them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: grey-scale weights (R, G, B)
GREY_WEIGHTS = {"luma709": (0.2125, 0.7154, 0.0721), "luma601": (0.299, 0.587, 0.114)}

#: fixed values: per-channel (mean, std) of the images the backbones were trained on
NORMALIZATIONS = {"imagenet": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))}


def backbone_stats(arch: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Channel (mean, std) for a backbone; only the resnet family has them."""
    if arch.startswith("resnet"):
        return NORMALIZATIONS["imagenet"]
    raise NotImplementedError(arch)


def as_array(h: int, w: int, pixels: bytes, channels: int = 3) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(int(h), int(w), channels)


def grey_array(img: np.ndarray, weights: str) -> np.ndarray:
    """``luma709``: doubles in [0, 1]; ``luma601``: rounded levels 0…255."""
    r, g, b = GREY_WEIGHTS[weights]
    if weights == "luma601":
        # whole-number arithmetic, so that equal pixels always round the same way
        wide = img.astype(np.int64)
        total = wide[..., 0] * 299 + wide[..., 1] * 587 + wide[..., 2] * 114
        return ((total + 500) // 1000).astype(np.uint8)
    unit = img.astype(np.float64) / 255.0
    return unit[..., 0] * r + unit[..., 1] * g + unit[..., 2] * b


def image_udf(fn, returns: str):
    """Column function ``(h, w, pixels, *extra)`` from ``fn(array, *extra)``; NULL stays NULL."""

    @F.pandas_udf(returns)
    def run(args: pd.DataFrame) -> pd.Series:
        out = []
        for h, w, px, *extra in args.itertuples(index=False, name=None):
            out.append(None if px is None else fn(as_array(h, w, px), *extra))
        return pd.Series(out, dtype=object)

    def call(h: Column | str = "h", w: Column | str = "w", pixels: Column | str = "pixels", *extra: Column) -> Column:
        cols = [F.col(c) if isinstance(c, str) else c for c in (h, w, pixels)]
        args = cols + list(extra)
        return run(F.struct(*[c.alias(f"a{n}") for n, c in enumerate(args)]))

    return call


@F.pandas_udf(T.BinaryType())
def source_to_rgb(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Bytes of Spark's image source (B, G, R[, A] or grey) as RGB, alpha dropped."""
    out = []
    for h, w, c, d in zip(height, width, channels, data):
        if d is None or h <= 0 or w <= 0:
            out.append(None)
            continue
        img = as_array(h, w, d, int(c))
        img = np.repeat(img, 3, axis=2) if c == 1 else img[:, :, 2::-1]
        out.append(np.ascontiguousarray(img).tobytes())
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def over_white(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
    """RGBA bytes of Spark's image source (B, G, R, A) blended over white, as RGB."""
    out = []
    for h, w, d in zip(height, width, data):
        img = as_array(h, w, d, 4).astype(np.float64)
        alpha = img[:, :, 3:] / 255.0
        out.append(np.rint(img[:, :, 2::-1] * alpha + 255.0 * (1.0 - alpha)).astype(np.uint8).tobytes())
    return pd.Series(out, dtype=object)


def unit_tensor(**cols) -> Column:
    """Pixels in [0, 1], channel-first (all of R, then G, then B)."""
    return image_udf(lambda img: (img.transpose(2, 0, 1).ravel() / np.float32(255.0)), "array<float>")(**cols)


def normalize(stats, inverse: bool = False):
    """Column function over a channel-first tensor: ``(x - mean) / std`` or its inverse."""
    mean, std = (np.asarray(v, dtype=np.float64)[:, None] for v in stats)

    @F.pandas_udf("array<float>")
    def run(tensor: pd.Series) -> pd.Series:
        def one(t):
            x = np.asarray(t, dtype=np.float64).reshape(len(mean), -1)
            x = x * std + mean if inverse else (x - mean) / std
            return x.ravel().astype(np.float32)

        return tensor.map(one, na_action="ignore")

    return run


def to_grey(weights: str = "luma709", **cols) -> Column:
    """Grey-scale levels in row order: doubles in [0, 1], or 0…255 for ``luma601``."""
    if weights not in GREY_WEIGHTS:
        raise ValueError(f"unknown weights {weights!r}; one of {tuple(GREY_WEIGHTS)}")
    return image_udf(lambda img: grey_array(img, weights).ravel().astype(np.float64), "array<double>")(**cols)


def is_blank(**cols) -> Column:
    """One single value over the first two channels."""
    return image_udf(lambda img: bool(img[:, :, :2].min() == img[:, :, :2].max()), "boolean")(**cols)


def thumbnail(px: int, **cols) -> Column:
    """Every ``size // px``-th pixel of a square image, as ``struct<h,w,pixels>``."""

    def one(img: np.ndarray):
        if img.shape[0] != img.shape[1]:
            raise ValueError(f"thumbnails need square images, found {img.shape[:2]}")
        step = img.shape[0] // px
        if step < 1:
            raise ValueError(f"a {img.shape[0]} pixel image has no {px} pixel thumbnail")
        small = np.ascontiguousarray(img[::step, ::step])
        return {"h": small.shape[0], "w": small.shape[1], "pixels": small.tobytes()}

    return _struct_udf(one, "h int, w int, pixels binary")(**cols)


def _struct_udf(fn, returns: str):
    @F.pandas_udf(returns)
    def run(args: pd.DataFrame) -> pd.DataFrame:
        rows = [fn(as_array(*row[:3]), *row[3:]) for row in args.itertuples(index=False, name=None)]
        names = [f.strip().split(" ")[0] for f in returns.split(",")]
        return pd.DataFrame(rows, columns=names)

    def call(h: Column | str = "h", w: Column | str = "w", pixels: Column | str = "pixels", *extra: Column) -> Column:
        cols = [F.col(c) if isinstance(c, str) else c for c in (h, w, pixels)] + list(extra)
        return run(F.struct(*[c.alias(f"a{n}") for n, c in enumerate(cols)]))

    return call


def moments(**cols) -> Column:
    """Per image: pixel count and, per channel, sum and sum of squares of [0, 1] levels."""

    def one(img: np.ndarray):
        x = img.reshape(-1, 3).astype(np.int64)
        s, q = x.sum(axis=0), (x * x).sum(axis=0)
        return {"n": len(x), "s": (s / 255.0).tolist(), "q": (q / 65025.0).tolist()}

    return _struct_udf(one, "n long, s array<double>, q array<double>")(**cols)


def to_uint8(levels: Column) -> Column:
    """Levels scaled by their own min/max to whole numbers 0…255; flat images give zeros."""

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            v = np.asarray(v, dtype=np.float64)
            lo, hi = v.min(), v.max()
            v = (v - lo) / (hi - lo) * 255.0 if hi - lo > 1e-8 else v - lo
            return v.astype(np.uint8).astype(np.int32)

        return values.map(one, na_action="ignore")

    return run(levels)


def levels_above(levels: Column, threshold: Column) -> Column:
    """Number of grey levels strictly above a threshold."""
    return F.size(F.filter(levels, lambda v: v > threshold))
