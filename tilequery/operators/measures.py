"""Per-tile measures: threshold masks, their connected objects, and organisation indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tilequery.functions.pixels import as_array, grey_array
from tilequery.schema import require

#: fixed values: the threshold sweep of grey levels
SWEEP = tuple(range(30, 200, 10))


def mask_objects(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-connected objects of one mask: size, centroid row, centroid column.

    Works on horizontal runs of set pixels; runs that touch in adjacent rows take
    the smaller label until nothing changes.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    span = w + 2
    below = (row + 1) * span
    lo = np.searchsorted(row * span + end, below + start, side="right")
    hi = np.searchsorted(row * span + start, below + end, side="left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    length = (end - start).astype(np.float64)
    size = np.bincount(label, length, n)
    rows = np.bincount(label, length * row, n)
    cols = np.bincount(label, length * (start + end - 1) / 2.0, n)
    keep = size > 0
    return size[keep], rows[keep] / size[keep], cols[keep] / size[keep]


def stacked_objects(masks: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Objects of many masks of one shape, labelled in one go: the masks lie below each other, a blank row apart."""
    n, h, w = masks.shape
    size, row, col = mask_objects(np.pad(masks, ((0, 0), (0, 1), (0, 0))).reshape(n * (h + 1), w))
    owner = (row // (h + 1)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    size, row, col, owner = size[order], row[order], col[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n + 1))
    row = row - owner * (h + 1)
    return [(size[a:b], row[a:b], col[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def _iorg(ci: np.ndarray, cj: np.ndarray, area: int) -> float | None:
    """Area under the observed against the random nearest-neighbour distribution (0.5 = random)."""
    n = len(ci)
    if n < 2:
        return None
    near = np.empty(n)
    for lo in range(0, n, 512):
        d = (ci[lo : lo + 512, None] - ci) ** 2 + (cj[lo : lo + 512, None] - cj) ** 2
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        near[lo : lo + 512] = d.min(axis=1)
    near.sort()
    random = np.concatenate([[0.0], 1.0 - np.exp(-n / area * np.pi * near), [1.0]])
    seen = np.concatenate([[0.0], np.arange(1, n + 1) / n, [1.0]])
    return float(np.sum((random[1:] - random[:-1]) * (seen[1:] + seen[:-1]) / 2.0))


def _scai(ci: np.ndarray, cj: np.ndarray, h: int, w: int) -> float | None:
    """``N / Nmax * D0 / L * 1000`` with D0 the geometric mean pair distance."""
    n = len(ci)
    if n < 2:
        return None
    total = 0.0
    for k in range(1, n):  # pair sums by offset keep memory linear
        total += float(np.log(np.hypot(ci[k:] - ci[:-k], cj[k:] - cj[:-k])).sum())
    d0 = np.exp(total / (n * (n - 1) / 2))
    return float(n / (h * w / 2.0) * d0 / np.sqrt(h * w) * 1000.0)


def _mask(img: np.ndarray, threshold: float) -> np.ndarray:
    return grey_array(img, "luma601") > threshold


def _masked_fraction(img, greyscale_threshold=120.0):
    return {"masked_fraction": float(_mask(img, greyscale_threshold).mean())}


def _object_counts(img, greyscale_threshold=120.0):
    size, _, _ = mask_objects(_mask(img, greyscale_threshold))
    return {"n_objects": len(size), "largest": int(size.max()) if len(size) else 0}


def _conv_org(img, greyscale_threshold=120.0):
    m = _mask(img, greyscale_threshold)
    _, ci, cj = mask_objects(m)
    return {"iorg": _iorg(ci, cj, m.size), "scai": _scai(ci, cj, *m.shape)}


#: measure name -> (function of an image, result columns)
MEASURES = {
    "masked_fraction": (_masked_fraction, "masked_fraction double"),
    "object_counts": (_object_counts, "n_objects int, largest int"),
    "conv_org_coeffs": (_conv_org, "iorg double, scai double"),
}


def register_measure(name: str, fn, schema: str) -> None:
    """Add a measure: ``fn(image array, **kwargs) -> dict`` with its result columns."""
    MEASURES[name] = (fn, schema)


def measure_tiles(images: DataFrame, name: str, key: str = "tile_id", **kwargs) -> DataFrame:
    """One row per tile with a named measure."""
    if name not in MEASURES:
        raise NotImplementedError(f"unknown measure {name!r}; one of {sorted(MEASURES)}")
    fn, schema = MEASURES[name]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [fn(as_array(h, w, px), **kwargs) for h, w, px in zip(pdf["h"], pdf["w"], pdf["pixels"])]
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=columns, dtype=object)], axis=1)

    kind = images.schema[key].dataType.simpleString()
    return require(images, key, "h", "w", "pixels").select(key, "h", "w", "pixels").mapInPandas(run, f"{key} {kind}, {schema}")


def iorg(images: DataFrame, threshold: float = 120.0, key: str = "tile_id") -> DataFrame:
    return measure_tiles(images, "conv_org_coeffs", key, greyscale_threshold=threshold).select(key, "iorg")


def scai(images: DataFrame, threshold: float = 120.0, key: str = "tile_id") -> DataFrame:
    return measure_tiles(images, "conv_org_coeffs", key, greyscale_threshold=threshold).select(key, "scai")


def tile_objects(images: DataFrame, threshold: float = 120.0, key: str = "tile_id") -> DataFrame:
    """Objects of each tile's mask: ``key, n_px, row, col`` (centroid)."""

    def run(batches):
        for pdf in batches:
            for k, h, w, px in zip(pdf[key], pdf["h"], pdf["w"], pdf["pixels"]):
                size, ci, cj = mask_objects(_mask(as_array(h, w, px), threshold))
                if len(size):
                    yield pd.DataFrame({key: k, "n_px": size.astype(np.int32), "row": ci, "col": cj})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "h", "w", "pixels").mapInPandas(run, f"{key} {kind}, n_px int, row double, col double")


def threshold_sweep(images: DataFrame, levels=SWEEP, key: str = "tile_id") -> DataFrame:
    """Masked fraction, object count and organisation indices per tile and grey threshold; each image is read once."""
    levels = [float(v) for v in levels]

    limits = np.array(levels)

    def run(batches):
        for pdf in batches:
            for (h, w), part in pdf.groupby(["h", "w"], sort=False):
                area = int(h) * int(w)
                at_once = max(1, 4_000_000 // (area * len(levels)))
                for lo in range(0, len(part), at_once):
                    some = part.iloc[lo : lo + at_once]
                    grey = np.stack([grey_array(as_array(h, w, px), "luma601") for px in some["pixels"]])
                    masks = grey[:, None] > limits[None, :, None, None]
                    found = stacked_objects(masks.reshape(-1, int(h), int(w)))
                    yield pd.DataFrame(
                        {
                            key: np.repeat(some[key].to_numpy(), len(levels)),
                            "threshold": np.tile(limits, len(some)),
                            "masked_fraction": masks.mean(axis=(2, 3)).ravel(),
                            "n_objects": [len(c) for _, c, _ in found],
                            "iorg": pd.Series([_iorg(r, c, area) for _, r, c in found], dtype=object),
                            "scai": pd.Series([_scai(r, c, int(h), int(w)) for _, r, c in found], dtype=object),
                        }
                    )

    kind = images.schema[key].dataType.simpleString()
    out = f"{key} {kind}, threshold double, masked_fraction double, n_objects int, iorg double, scai double"
    return images.select(key, "h", "w", "pixels").mapInPandas(run, out)
