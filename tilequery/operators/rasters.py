"""The data behind scene maps: colours, extents, footprints, component and distance maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.functions.names import CROP_NAME, format_name
from tilequery.functions.vectors import distance, vector_literal
from tilequery.operators.sampling import centroids
from tilequery.operators.select import component, palette_of, slice_xy
from tilequery.operators.stats import min_max
from tilequery.schema import require

#: fixed values: label colours (red, green, blue), used in turn
PALETTE = (
    (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.0, 0.5, 0.0),
    (0.29, 0.0, 0.51), (1.0, 0.55, 0.0), (0.0, 1.0, 1.0), (1.0, 0.75, 0.8), (0.6, 0.8, 0.2),
)


def make_rgb(df: DataFrame, comps: list[int], alpha: float = 0.5, vector: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """Three components as r, g, b in [0, 1], each by its own min and max, with a constant alpha.

    ``by`` scales within groups (per scene) instead of over all rows; a constant component gives 0.
    """
    if len(comps) != 3:
        raise ValueError("exactly three components make an RGB value")
    rows = component(df, *comps, vector=vector, prefix="_c")
    names = [f"_c{k}" for k in comps]
    lim = min_max(rows, sorted(set(names)), by)
    ends = F.struct(*[F.col(f"{e}_{c}") for c in sorted(set(names)) for e in ("lo", "hi")]).alias("_lim")
    if by:
        rows = rows.join(lim.select(*by, ends), by)
    else:
        rows = rows.withColumn("_lim", lim.select(ends).scalar())

    def unit(c: str) -> Column:
        lo, hi = F.col("_lim")[f"lo_{c}"], F.col("_lim")[f"hi_{c}"]
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    rgba = {n: unit(c) for n, c in zip("rgb", names)}
    return rows.withColumns({**rgba, "a": F.lit(float(alpha))}).drop(*set(names), "_lim")


def label_colours(df: DataFrame, label: str = "label", palette=PALETTE, alpha: float = 0.3, background=None) -> DataFrame:
    """Colour of each discrete label, by its position in sort order; rows without label and the ``background`` label are white."""
    colours = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("rgb", c)]) for c in palette])
    out = df.join(palette_of(df, label), label, "left")
    white = F.struct(*[F.lit(1.0).alias(n) for n in "rgb"])
    blank = F.col(label).isNull() if background is None else F.col(label).isNull() | (F.col(label) == F.lit(background))
    c = F.when(blank, white).otherwise(F.get(colours, F.pmod(F.col("palette_pos"), F.lit(len(palette)))))
    return out.withColumn("_c", c).select(*df.columns, "palette_pos", "_c.r", "_c.g", "_c.b", F.lit(float(alpha)).alias("a"))


def image_extent(df: DataFrame, by: str = "scene_id", cropped: bool = True) -> DataFrame:
    """Pixel and coordinate limits of the tile centres per scene, widened by half a step when ``cropped``.

    Steps follow from the limits and the number of distinct values; the result fails for a scene
    whose centres do not lie on even steps.
    """
    axes = [c for c in ("i0", "j0", "x", "y") if c in df.columns]
    agg = []
    for c in axes:
        agg += [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.countDistinct(c).alias(f"n_{c}")]
    limits = df.groupBy(by).agg(*agg)
    # how far from a whole number of steps the centres lie, at most
    def off(c):
        steps = (F.col(c) - F.col(f"lo_{c}")) * (F.col(f"n_{c}") - 1) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0))
        return F.coalesce(F.max(F.abs(steps - F.round(steps))), F.lit(0.0)).alias(f"off_{c}")

    out = limits.join(df.select(by, *axes).join(limits, by).groupBy(by).agg(*[off(c) for c in axes]), by)
    for c in axes:
        step = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (F.col(f"n_{c}") - 1)
        half = F.floor(step / 2) if cropped else F.lit(0)
        half = F.when(F.col(f"n_{c}") > 1, half).otherwise(F.lit(0))
        out = out.withColumns(
            {f"{c}_min": F.when(F.col(f"off_{c}") > 1e-6, F.raise_error(F.lit(f"uneven steps in {c}")).cast("double")).otherwise((F.col(f"lo_{c}") - half).cast("double")), f"{c}_max": (F.col(f"hi_{c}") + half).cast("double")}
        )
    return out.select(by, *[f"{c}_{e}" for c in axes for e in ("min", "max")])


def component_map(df: DataFrame, comps: list[int], vector: str = "embedding", variance: DataFrame | None = None) -> DataFrame:
    """One row per tile and component, with the component's explained variance when given."""
    want = F.array(*[F.struct(F.lit(k).alias("component"), F.get(F.col(vector), F.lit(k)).cast("double").alias("value")) for k in comps])
    out = df.withColumn("_c", F.explode(want)).drop(vector).select("*", "_c.*").drop("_c")
    if variance is not None:
        out = out.join(variance.select("component", F.round("explained_variance", 2).alias("explained_variance")), "component", "left")
    return out


def footprints(df: DataFrame, lx: float | Column, ly: float | Column) -> DataFrame:
    """Rectangle of a tile around its centre."""
    lx, ly = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lx, ly))
    return df.withColumns(
        {"x_min": F.col("x") - lx / 2.0, "x_max": F.col("x") + lx / 2.0, "y_min": F.col("y") - ly / 2.0, "y_max": F.col("y") + ly / 2.0}
    )


def distance_map(df: DataFrame, x: tuple = (None, None), y: tuple = (None, None), vector: str = "embedding") -> DataFrame:
    """L2 distance of every tile to the mean vector of the tiles within a box."""
    box = slice_xy(df, x, y).withColumn("_all", F.lit(1))
    row = centroids(box, "_all", vector).first()
    if row is None:
        raise ValueError("no tile within the selected box")
    return df.withColumn("dist", distance(vector, vector_literal(row["centroid"]))).drop(vector)


def scatter_table(df: DataFrame, vector: str = "embedding", x_min: float | None = None) -> DataFrame:
    """First four components as x, y, z, colour and the name of the tile picture."""
    rows = slice_xy(df, (x_min, None)) if x_min is not None else df
    pick = lambda k: F.get(F.col(vector), F.lit(k)).cast("double")
    return require(rows, "scene_id", "i0", "j0").select(
        "scene_id", "i0", "j0",
        pick(0).alias("px"), pick(1).alias("py"), pick(2).alias("pz"), pick(3).alias("colour"),
        format_name(CROP_NAME, "png").alias("image"),
    )


def map_info(df: DataFrame, step: int, by: str = "scene_id") -> DataFrame:
    """Tile resolution and step in km per scene; tiles must be equally fine in x and y."""
    dx, dy = F.col("lx_tile") / F.col("tile_nx"), F.col("ly_tile") / F.col("tile_ny")
    rows = df.select(by, dx.alias("_dx"), dy.alias("_dy")).distinct()
    if not rows.filter(F.col("_dx") != F.col("_dy")).isEmpty():
        raise ValueError("x and y resolution differ")
    res = F.col("_dx") / 1000.0
    return rows.select(by, res.alias("tile_resolution_km"), (res * step).alias("step_km"))
