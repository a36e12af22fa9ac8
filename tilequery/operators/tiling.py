"""Moving-window tiling of scenes and crops."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.operators.select import numbered
from tilequery.operators.stats import assert_uniform
from tilequery.schema import require

#: fixed values: default tile size and step in pixels
TILE = (256, 256)
STEP = (50, 50)
#: bytes of a scene's band at most (one window row is always whole), tile heights of a band that points meet
BAND_BYTES, POINT_BAND = 64 << 20, 4


def n_windows(n: int, tile: int, step: int) -> int:
    """Number of window positions along one side."""
    return (n - tile) // step + 1 if n >= tile else 0


def moving_windows(scenes: DataFrame, step: tuple[int, int] = STEP, tile: tuple[int, int] = TILE) -> DataFrame:
    """Every window of every scene: pixel start ``(i, j)`` and its number ``spatial`` within the scene.

    Scenes smaller than a tile have no window.
    """
    require(scenes, "scene_id", "nx", "ny")
    (nxt, nyt), (sx, sy) = tile, step
    fits = (F.col("nx") >= nxt) & (F.col("ny") >= nyt)
    i = F.sequence(F.lit(0), F.col("nx") - nxt, F.lit(sx))
    j = F.sequence(F.lit(0), F.col("ny") - nyt, F.lit(sy))
    nt_x = F.floor((F.col("nx") - nxt) / sx).cast("int") + 1
    return (
        scenes.filter(fits)
        .withColumn("j", F.explode(j))
        .withColumn("i", F.explode(i))
        .withColumn("spatial", (F.col("j") / sy).cast("int") * nt_x + (F.col("i") / sx).cast("int"))
    )


def window_ij(df: DataFrame, nt_x: int, step: tuple[int, int] = STEP, spatial: str = "spatial") -> DataFrame:
    """Pixel start of a window number: row-major over the windows of a scene."""
    j = F.floor(F.col(spatial) / nt_x).cast("int")
    return df.withColumns({"i": (F.col(spatial) - j * nt_x).cast("int") * step[0], "j": j * step[1]})


def split_tile_id(df: DataFrame, tiles_per_scene: int, key: str = "tile_id") -> DataFrame:
    """Scene position and window number of a dense tile id."""
    return df.withColumns(
        {
            "scene_pos": F.floor(F.col(key) / tiles_per_scene).cast("long"),
            "spatial": F.pmod(F.col(key), F.lit(tiles_per_scene)).cast("int"),
        }
    )


def number_tiles(scenes: DataFrame, step: tuple[int, int] = STEP, tile: tuple[int, int] = TILE) -> DataFrame:
    """Windows of all scenes with dense tile ids, scenes in order of their file name.

    All scenes must have one shape; only the scene table is numbered.
    """
    nx, ny = assert_uniform(scenes, "nx", "ny")
    per_scene = n_windows(nx, tile[0], step[0]) * n_windows(ny, tile[1], step[1])
    if per_scene == 0:
        raise ValueError(f"scenes of {nx} x {ny} pixels cannot hold a tile of {tile}")
    pos = numbered(scenes.select("scene_id", "filepath", "nx", "ny"), "filepath", "scene_id", name="scene_pos")
    return moving_windows(pos, step, tile).select(
        (F.col("scene_pos") * per_scene + F.col("spatial")).alias("tile_id"),
        "scene_id",
        F.col("filepath").alias("scene_filepath"),
        "i",
        "j",
    )


def with_centres(df: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """Pixel at the centre of each window and the tile size."""
    return df.withColumns(
        {
            "i0": (F.col("i") + F.lit(0.5 * tile[0])).cast("int"),
            "j0": (F.col("j") + F.lit(0.5 * tile[1])).cast("int"),
            "tile_nx": F.lit(tile[0]),
            "tile_ny": F.lit(tile[1]),
        }
    )


def centred_windows(points: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """Windows centred on points (with ``nx, ny`` of their scene); ``valid`` when the tile stays inside."""
    hx, hy = tile[0] // 2, tile[1] // 2
    ok = F.col("i").between(F.lit(hx), F.col("nx") - hx) & F.col("j").between(F.lit(hy), F.col("ny") - hy)
    ok = F.coalesce(ok, F.lit(False))
    return points.withColumns(
        {"valid": ok, "i_start": F.when(ok, F.col("i") - hx), "j_start": F.when(ok, F.col("j") - hy)}
    )


def windows_of(batch: pa.RecordBatch, tile: tuple[int, int], step: tuple[int, int]):
    """``scene_id, j, i, crop`` of every window of a batch of bands; a crop is a view of its band."""
    nxt, nyt = tile
    sx, sy = step
    for r in range(batch.num_rows):
        scene, j, w = (batch.column(c)[r].as_py() for c in ("scene_id", "j", "w"))
        img = np.frombuffer(batch.column("band")[r].as_buffer(), dtype=np.uint8).reshape(-1, w, 3)
        for y in range(0, len(img) - nyt + 1, sy):
            for x in range(0, w - nxt + 1, sx):
                yield scene, j + y, x, img[y : y + nyt, x : x + nxt]


def _cut(tile: tuple[int, int], step: tuple[int, int]):
    """Crops out of bands; yields a bounded number of crops at a time."""
    nxt, nyt = tile

    def run(batches):
        for batch in batches:
            windows = windows_of(batch, tile, step)
            while part := list(islice(windows, 64)):
                scene, j, i, crops = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(scene, batch.column("scene_id").type),
                        pa.array(j, pa.int32()),
                        pa.array(i, pa.int32()),
                        pa.array([nyt] * len(part), pa.int32()),
                        pa.array([nxt] * len(part), pa.int32()),
                        pa.array([np.ascontiguousarray(c).tobytes() for c in crops], pa.binary()),
                    ],
                    names=["scene_id", "j", "i", "h", "w", "pixels"],
                )

    return run


def scene_bands(images: DataFrame, step: tuple[int, int] = STEP, tile: tuple[int, int] = TILE, spread: bool = True) -> DataFrame:
    """Scene images cut into bands of many window rows (plain byte ranges, in the JVM): ``scene_id, j, w, band``.

    A band begins at the window row ``j`` and ends with the last pixel row that its last window row needs, so only the overlap of a
    tile with the next step is held by two bands. It has as many window rows as keep that overlap below half of
    the band's own rows, less for scenes so wide that it would exceed ``BAND_BYTES``.
    ``spread`` shuffles the bands, so that one large scene is worked on by many tasks.
    """
    require(images, "scene_id", "h", "w", "pixels")
    (nxt, nyt), (_, sy) = tile, step
    halo = max(0, nyt - sy)
    most = max(1, -(-2 * halo // sy))
    fit = F.floor((F.lit(BAND_BYTES) / (3 * F.col("w")) - halo) / sy)
    own = (F.greatest(F.lit(1), F.least(F.lit(most), fit)) * sy).cast("int")
    rows = F.least(F.col("_own") + halo, F.col("h") - F.col("j"))
    bands = (
        images.filter((F.col("w") >= nxt) & (F.col("h") >= nyt))
        .withColumn("_own", own)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("h") - nyt, F.col("_own"))))
        .select("scene_id", "j", "w", F.substring(F.col("pixels"), F.col("j") * F.col("w") * 3 + 1, rows * F.col("w") * 3).alias("band"))
    )
    return bands.repartition("scene_id", "j") if spread else bands


def crop_scenes(images: DataFrame, step: tuple[int, int] = STEP, tile: tuple[int, int] = TILE, spread: bool = True) -> DataFrame:
    """Pixels of every window of scene images ``(scene_id, h, w, pixels)``."""
    kind = images.schema["scene_id"].dataType.simpleString()
    bands = scene_bands(images, step, tile, spread)
    return bands.mapInArrow(_cut(tile, step), f"scene_id {kind}, j int, i int, h int, w int, pixels binary")


def crop_points(windows: DataFrame, images: DataFrame, tile: tuple[int, int] = TILE) -> DataFrame:
    """Pixels of point-centred windows (``valid`` rows only).

    Scenes are cut into bands of four tile heights and one more, so that every window lies in the one band that its first row names:
    points meet bands, not scenes, by scene and band. Each point takes just the rows it needs out of its band before
    anything is handed to Python.
    """
    nxt, nyt = tile
    own = POINT_BAND * nyt
    px = (
        images.filter(F.col("h") >= nyt)
        .withColumn("_band", F.explode(F.sequence(F.lit(0), F.floor((F.col("h") - nyt) / own).cast("int"))))
        .select("scene_id", "_band", F.col("w").alias("_w"), F.substring(F.col("pixels"), F.col("_band") * own * F.col("w") * 3 + 1, F.lit(own + nyt) * F.col("w") * 3).alias("_px"))
    )
    strip = F.substring(F.col("_px"), (F.col("j_start") - F.col("_band") * own) * F.col("_w") * 3 + 1, F.lit(nyt) * F.col("_w") * 3)
    rows = windows.filter("valid").withColumn("_band", F.floor(F.col("j_start") / own).cast("int"))
    rows = rows.join(px, ["scene_id", "_band"]).withColumn("_strip", strip).drop("_px", "_band")
    cut = _crop_columns(nxt, nyt)
    return rows.withColumns(
        {"h": F.lit(nyt), "w": F.lit(nxt), "pixels": cut(F.col("_strip"), F.col("_w"), F.col("i_start"))}
    ).drop("_strip", "_w")


def _crop_columns(nxt: int, nyt: int):
    @F.pandas_udf("binary")
    def run(strip: pd.Series, width: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series(
            [
                np.ascontiguousarray(np.frombuffer(s, np.uint8).reshape(nyt, int(w), 3)[:, int(i) : int(i) + nxt]).tobytes()
                for s, w, i in zip(strip, width, start)
            ],
            dtype=object,
        )

    return run


def attach_coords(df: DataFrame, xs: DataFrame, ys: DataFrame, tile: tuple[int, int] = TILE, latlon: DataFrame | None = None) -> DataFrame:
    """Scene coordinates of tile centres: x by ``i0``, y by the reversed ``j0``, lat/lon by both.

    ``xs``: ``scene_id, i, x``; ``ys``: ``scene_id, j, y`` (y grows with j); tile lengths
    ``lx_tile``/``ly_tile`` span one tile from the first coordinate. A tile whose scene,
    column or row has no coordinate fails the result.
    """
    size_y = ys.groupBy("scene_id").agg(F.count("*").alias("_ny"))
    first = lambda t, c, v, n: t.groupBy("scene_id").agg(
        (F.max(F.when(F.col(c) == n, F.col(v))) - F.max(F.when(F.col(c) == 0, F.col(v)))).alias(f"l{v}_tile")
    )
    per_scene = size_y.join(first(xs, "i", "x", tile[0]), "scene_id").join(first(ys, "j", "y", tile[1]), "scene_id")
    out = df.join(per_scene, "scene_id", "left").withColumn("_j", F.col("_ny") - 1 - F.col("j0"))
    out = out.join(xs.select("scene_id", F.col("i").alias("i0"), "x"), ["scene_id", "i0"], "left").join(
        ys.select("scene_id", F.col("j").alias("_j"), "y"), ["scene_id", "_j"], "left"
    )
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a tile without {c} coordinate")).cast("double"))
    out = out.withColumns({"x": known("x"), "y": known("y")})
    if latlon is not None:
        ll = latlon.select("scene_id", F.col("i").alias("i0"), F.col("j").alias("_j"), "lat", "lon")
        out = out.join(ll, ["scene_id", "i0", "_j"], "left")
    return out.drop("_ny", "_j")


def tile_centres(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Every (x, y) of a scene's coordinate lists."""
    return xs.select("scene_id", "x").join(ys.select("scene_id", "y"), "scene_id")


def register_sql(spark) -> None:
    """``moving_window(nx, ny, nxt, nyt, sx, sy)`` as a table function for SQL: one row ``(i, j)`` per window."""
    spark.sql(
        """create or replace temporary function moving_window(nx int, ny int, nxt int, nyt int, sx int, sy int)
           returns table (i int, j int)
           return select i, j from inline(if(nx >= nxt and ny >= nyt,
                  flatten(transform(sequence(0, ny - nyt, sy), b -> transform(sequence(0, nx - nxt, sx), a -> named_struct('i', a, 'j', b)))),
                  cast(array() as array<struct<i: int, j: int>>)))"""
    )
