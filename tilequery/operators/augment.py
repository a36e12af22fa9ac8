"""Image chains for prediction and training: normalisation, then seeded augmentation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.functions.pixels import backbone_stats, normalize, unit_tensor

#: number of independent draws one image needs
DRAWS = 17


def draws(key: str, seed: int, epoch: int, n: int = DRAWS) -> Column:
    """``n`` uniform numbers in [0, 1) per row, fixed by (seed, epoch, key)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(key), k), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52)),
    )


def _homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Projective map taking four points to four points."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return np.append(np.linalg.solve(np.array(rows, dtype=float), np.array(rhs, dtype=float)), 1.0).reshape(3, 3)


def _resample(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Bilinear values of ``x`` (c, h, w) at the places ``m`` sends each pixel to; zero outside."""
    _, h, w = x.shape
    jj, ii = np.mgrid[0:h, 0:w]
    p = np.tensordot(m, np.stack([ii, jj, np.ones_like(ii)]).astype(float), axes=1)
    u, v = p[0] / p[2], p[1] / p[2]
    i0, j0 = np.floor(u).astype(int), np.floor(v).astype(int)
    out = np.zeros_like(x)
    for di in (0, 1):
        for dj in (0, 1):
            i, j = i0 + di, j0 + dj
            weight = (1 - np.abs(u - i)) * (1 - np.abs(v - j))
            ok = (i >= 0) & (i < w) & (j >= 0) & (j < h)
            out += np.where(ok, weight, 0.0) * x[:, np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
    return out


def _augment_one(x: np.ndarray, u: np.ndarray, o: dict) -> np.ndarray:
    if u[0] < o["p_flip_vertical"]:
        x = x[:, ::-1]
    if u[1] < o["p_flip_horizontal"]:
        x = x[:, :, ::-1]
    _, h, w = x.shape
    if u[2] < o["p_affine"]:
        a = np.deg2rad((2 * u[3] - 1) * o["max_rotation"])
        zoom = 1.0 + u[4] * (o["max_zoom"] - 1.0)
        c, s = np.cos(a) / zoom, np.sin(a) / zoom
        ci, cj = (w - 1) / 2.0, (h - 1) / 2.0
        x = _resample(x, np.array([[c, -s, ci - c * ci + s * cj], [s, c, cj - s * ci - c * cj], [0, 0, 1.0]]))
    if u[8] < o["p_affine"]:
        reach = np.array([w, h]) * o["max_warp"] / 2.0
        corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=float)
        inward = np.array([[1, 1], [-1, 1], [-1, -1], [1, -1]])
        x = _resample(x, _homography(corners, corners + inward * u[9:17].reshape(4, 2) * reach))
    if u[5] < o["p_lighting"]:
        light = (2 * u[6] - 1) * o["max_lighting"]
        contrast = 1.0 + (2 * u[7] - 1) * o["max_lighting"]
        x = x * contrast + light
    return np.ascontiguousarray(x)


def augment(images: DataFrame, epoch: int = 0, seed: int = 0, key: str = "tile_id", tensor: str = "tensor", p_flip_vertical: float = 0.5,
            p_flip_horizontal: float = 0.5, max_rotation: float = 10.0, max_zoom: float = 1.1, max_warp: float = 0.2,
            p_affine: float = 0.75, max_lighting: float = 0.2, p_lighting: float = 0.75) -> DataFrame:
    """Randomly flipped, rotated, zoomed, warped and lit tensors (``h, w, tensor`` channel-first).

    The draws are a hash of (seed, epoch, key): a re-run, or a retried task, gives the same images.
    """
    o = {
        "p_flip_vertical": p_flip_vertical, "p_flip_horizontal": p_flip_horizontal, "max_rotation": max_rotation,
        "max_zoom": max_zoom, "max_warp": max_warp, "p_affine": p_affine, "max_lighting": max_lighting, "p_lighting": p_lighting,
    }

    @F.pandas_udf("array<float>")
    def run(h: pd.Series, w: pd.Series, x: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(
            [_augment_one(np.asarray(t, dtype=float).reshape(-1, int(a), int(b)), np.asarray(r), o).ravel().astype(np.float32)
             for a, b, t, r in zip(h, w, x, u)],
            dtype=object,
        )

    return images.withColumn(tensor, run("h", "w", tensor, draws(key, seed, epoch)))


def image_chain(images: DataFrame, step: str, arch: str = "resnet18", epoch: int = 0, seed: int = 0, key: str = "tile_id") -> DataFrame:
    """Tensors ready for a model: normalised for the backbone, and for ``train`` augmented after that."""
    if step not in ("train", "predict"):
        raise NotImplementedError(step)
    stats = backbone_stats(arch)
    out = images.withColumn("tensor", normalize(stats)(unit_tensor())).drop("pixels")
    return augment(out, epoch, seed, key) if step == "train" else out
