"""Batch embedding of tiles, scenes and trajectory points with a user-supplied model.

A model is given as ``make_predict_fn() -> predict(x)``: called once per Python
worker task, ``predict`` takes float32 images in [0, 1] as (n, 3, h, w) and
returns (n, dims). Ids travel with the rows; nothing depends on row positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.functions.pixels import as_array
from tilequery.operators import tiling
from tilequery.operators.select import pending
from tilequery.schema import require

#: fixed values: default embedding width and prediction batch
DIMS = 100
BATCH = 32

PredictFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


def _predict(predict, images: list[np.ndarray], batch_size: int) -> list[np.ndarray]:
    """Predict in batches; images of different shapes go in different calls, results keep the order."""
    out: list = [None] * len(images)
    shapes: dict[tuple, list[int]] = {}
    for n, img in enumerate(images):
        shapes.setdefault(img.shape, []).append(n)
    for rows in shapes.values():
        for lo in range(0, len(rows), batch_size):
            part = rows[lo : lo + batch_size]
            x = np.stack([images[n] for n in part]).transpose(0, 3, 1, 2).astype(np.float32) / np.float32(255.0)
            y = np.asarray(predict(x), dtype=np.float32)
            if y.shape[0] != len(part):
                raise ValueError(f"the model returned {y.shape[0]} vectors for {len(part)} images")
            for n, v in zip(part, y):
                out[n] = v
    return out


def embed(images: DataFrame, make_predict_fn: PredictFactory, batch_size: int = BATCH, out: str = "embedding") -> DataFrame:
    """Vector of each image row ``(h, w, pixels)``; the pixels are dropped, NULL pixels give NULL."""
    require(images, "h", "w", "pixels")

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for pdf in parts:
            res = pd.Series([None] * len(pdf), dtype=object)
            have = [n for n, px in enumerate(pdf["pixels"]) if px is not None]
            imgs = [as_array(pdf["h"].iloc[n], pdf["w"].iloc[n], pdf["pixels"].iloc[n]) for n in have]
            for n, v in zip(have, _predict(predict, imgs, batch_size)):
                res.iat[n] = v
            yield res

    return images.withColumn(out, run(F.struct("h", "w", "pixels"))).drop("pixels", "h", "w")


def embed_scenes(scenes: DataFrame, make_predict_fn: PredictFactory, step: tuple[int, int] = tiling.STEP, tile: tuple[int, int] = tiling.TILE,
                 batch_size: int = BATCH, coords: tuple | None = None, spread: bool = True) -> DataFrame:
    """Embedding of every window of every scene: ``scene_id, i, j, i0, j0, tile_nx, tile_ny, embedding``.

    Cropping and prediction happen in one pass over bands of window rows, so window pixels
    (many times the scene) never leave the Python worker; a batch of predictions goes on from one band to the next.
    ``coords`` = ``(xs, ys[, latlon])`` attaches scene coordinates.
    """
    bands = tiling.scene_bands(scenes, step, tile, spread)
    kind = scenes.schema["scene_id"].dataType.simpleString()

    def run(batches):
        predict = make_predict_fn()
        windows = ((batch.column("scene_id").type, *window) for batch in batches for window in tiling.windows_of(batch, tile, step))
        while part := list(islice(windows, batch_size)):
            types, scene, j, i, crops = zip(*part)
            vecs = _predict(predict, list(crops), batch_size)
            flat = np.concatenate(vecs).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(scene, types[0]),
                    pa.array(j, pa.int32()),
                    pa.array(i, pa.int32()),
                    pa.FixedSizeListArray.from_arrays(pa.array(flat), len(vecs[0])).cast(pa.list_(pa.float32())),
                ],
                names=["scene_id", "j", "i", "embedding"],
            )

    out = tiling.with_centres(bands.mapInArrow(run, f"scene_id {kind}, j int, i int, embedding array<float>"), tile)
    if coords is not None:
        out = tiling.attach_coords(out, coords[0], coords[1], tile, coords[2] if len(coords) > 2 else None)
    return out


def embed_pending_scenes(scenes: DataFrame, done: DataFrame | None, make_predict_fn: PredictFactory, **kwargs) -> DataFrame:
    """As :func:`embed_scenes`, only for scenes without stored embeddings."""
    todo = scenes if done is None else pending(scenes, done)
    return embed_scenes(todo, make_predict_fn, **kwargs)


def embed_trajectories(points: DataFrame, scenes: DataFrame, make_predict_fn: PredictFactory, tile: tuple[int, int] = tiling.TILE,
                       batch_size: int = BATCH) -> DataFrame:
    """Vector of the tile around each trajectory point ``(scene_id, i, j)``; NULL where it would leave the image."""
    size = scenes.select("scene_id", F.col("w").alias("nx"), F.col("h").alias("ny"))
    windows = tiling.centred_windows(points.join(size, "scene_id", "left"), tile)
    keys = [c for c in points.columns]
    some = embed(tiling.crop_points(windows, scenes, tile), make_predict_fn, batch_size).select(*keys, "embedding")
    rest = windows.filter(~F.col("valid")).select(*keys, F.lit(None).cast("array<float>").alias("embedding"))
    return some.unionByName(rest)


def block_encoder(dims: int = DIMS, blocks: int = 4, seed: int = 0) -> PredictFactory:
    """A small fixed NumPy encoder: block means, spreads and gradients, projected by a seeded matrix."""

    def make():
        rng = np.random.default_rng(seed)
        weights = rng.standard_normal((3 * blocks * blocks * 2 + 6, dims)) / np.sqrt(dims)

        def predict(x: np.ndarray) -> np.ndarray:
            n, c, h, w = x.shape
            if h < blocks or w < blocks:
                raise ValueError(f"images of {h} x {w} pixels are smaller than {blocks} blocks")
            x = x.astype(np.float64)
            rows = np.arange(blocks) * h // blocks
            cols = np.arange(blocks) * w // blocks
            area = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(cols, w))[None, :]
            sums = lambda v: np.add.reduceat(np.add.reduceat(v, rows, axis=2), cols, axis=3) / area
            mean = sums(x)
            spread = np.sqrt(np.maximum(sums(x * x) - mean * mean, 0.0))
            grad = [np.abs(np.diff(x, axis=a)).mean(axis=(2, 3)) for a in (2, 3)]
            feats = np.concatenate([mean.reshape(n, -1), spread.reshape(n, -1), *grad], axis=1)
            return feats @ weights

        return predict

    return make
