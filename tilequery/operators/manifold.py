"""Views of a 2-D projection: grid bins with a representative tile, mosaics, grid samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.functions.pixels import thumbnail
from tilequery.operators.sampling import sample_grid
from tilequery.operators.select import with_images
from tilequery.operators.stats import inverse_ecdf
from tilequery.operators.triplets import pair_distance
from tilequery.schema import require


def manifold_extent(df: DataFrame, dx: float, centre: tuple[float, float] = (0.0, 0.0), lxy: float | None = None) -> tuple[float, int]:
    """``(lxy, n)``: side of the square around ``centre`` that holds all points, in whole cells of ``dx``."""
    if lxy is None:
        r = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if r[0] is None:
            raise ValueError("no points")
        lxy = 2.0 * max(abs(v) for v in (centre[0] - r[0], r[1] - centre[0], centre[1] - r[2], r[3] - centre[1]))
    n = int(lxy / dx)
    return n * dx, n


def bin_index(df: DataFrame, lxy: float, n: int, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Grid cell of each point. Truncation makes cell 0 one cell wider on its outer side."""
    cell = lxy / n
    at = {
        i: ((F.col(c) - F.lit(float(centre[k]) - lxy / 2.0)) / F.lit(cell)).cast("int")
        for k, (i, c) in enumerate((("ix", "x"), ("iy", "y")))
    }
    return df.withColumns(at).filter(F.col("ix").between(0, n - 1) & F.col("iy").between(0, n - 1))


def bin_manifold(df: DataFrame, lxy: float = 3.0, n: int = 16, n_min_tiles: int = 8, centre: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tiles per grid cell and the tile with the smallest ``an_dist``.

    ``n_min_tiles`` counts tiles (a limit on both components together is twice
    as large). With a boolean column ``blank`` the pick skips blank tiles, which
    still count as members.
    """
    require(df, "tile_id", "x", "y", "an_dist")
    best = F.struct("an_dist", "tile_id")
    if "blank" in df.columns:
        best = F.when(~F.col("blank"), best)
    return (
        bin_index(df, lxy, n, centre)
        .groupBy("ix", "iy")
        .agg(F.count("*").alias("n_tiles"), F.min(best).alias("b"))
        .filter(F.col("n_tiles") >= n_min_tiles)
        .select("ix", "iy", "n_tiles", F.col("b.tile_id").alias("tile_id"), F.col("b.an_dist").alias("an_dist"))
    )


def best_nonblank(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group the non-blank tile with the smallest ``an_dist`` (NULL when all are blank)."""
    require(df, "blank", "an_dist", "tile_id")
    pick = F.min(F.when(~F.col("blank"), F.struct("an_dist", "tile_id")))
    return df.groupBy(*by).agg(pick.alias("b")).select(
        *by, F.col("b.tile_id").alias("tile_id"), F.col("b.an_dist").alias("an_dist")
    )


def raster_rows(df: DataFrame, n: int) -> DataFrame:
    """Raster row and column of a cell: columns run with x, rows from the top down."""
    return df.withColumns({"row": F.lit(n - 1) - F.col("iy"), "col": F.col("ix")})


def mosaic(bins: DataFrame, images: DataFrame, n: int, px: int = 32) -> DataFrame:
    """Thumbnail of the picked tile of each cell, with its place in the raster (empty cells have no row)."""
    chosen = raster_rows(bins.filter(F.col("tile_id").isNotNull()), n)
    return with_images(chosen, images.select("tile_id", "h", "w", "pixels")).select(
        "ix", "iy", "row", "col", "tile_id", thumbnail(px).alias("thumb")
    )


def manifold_view(wide: DataFrame, xy: DataFrame, kind: str = "grid", dx: float = 0.05, n_min_tiles: int = 1,
                  centre: tuple[float, float] = (0.0, 0.0), lxy: float | None = None, an_dist_ecdf_threshold: float = 0.3,
                  sample_range: tuple[float, float] = (-1.5, 1.5)) -> DataFrame:
    """Data of the manifold plot from triplets and a 2-D projection ``tile_id, x, y`` of their anchors.

    ``grid`` bins the plane (the drawn square is padded by one cell on each side but
    keeps its number of cells); ``scatter`` samples grid nodes among the tiles
    below the given fraction of anchor–neighbour distances.
    """
    dist = pair_distance(wide).select("tile_id", "an_dist")
    pts = xy.join(dist, "tile_id")
    if kind == "grid":
        side, n = manifold_extent(xy, dx, centre, lxy)
        return bin_manifold(pts, side + 2.0 * dx, n, n_min_tiles, centre)
    if kind == "scatter":
        limit = inverse_ecdf(dist, "an_dist", an_dist_ecdf_threshold)
        return sample_grid(pts, dx, limit, sample_range, sample_range)
    raise NotImplementedError(kind)
