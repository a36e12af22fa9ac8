"""Latitude/longitude domains: point-in-domain, outlines, tile footprints in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed value: mean Earth radius in metres
EARTH_RADIUS = 6_371_000.0


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def in_extent(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Rows within a closed lon/lat box, read from west to east; it may span the date line or the whole circle."""
    west, width = float(lon[0]), float(lon[1]) - float(lon[0])
    rows = df.filter(F.col("lat").between(float(lat[0]), float(lat[1])))
    if abs(width) >= 360.0:
        return rows.filter(F.col("lon").isNotNull())
    return rows.filter(F.pmod(F.col("lon") - F.lit(west), F.lit(360.0)) <= width % 360.0)


def inside_polygon(lat: Column, lon: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting against a short list of (lat, lon) corners, all in the JVM.

    Each corner lies the shorter way round from the one before, so a polygon may span the date line.
    """
    if len(vertices) < 3:
        raise ValueError("a polygon needs at least three vertices")
    pts = [(float(vertices[0][0]), float(vertices[0][1]))]
    for a, o in vertices[1:]:
        before = pts[-1][1]
        pts.append((float(a), before + (float(o) - before + 180.0) % 360.0 - 180.0))
    west = min(o for _, o in pts)
    edges = F.array(
        *[
            F.struct(F.lit(a[0]).alias("a0"), F.lit(a[1]).alias("o0"), F.lit(b[0]).alias("a1"), F.lit(b[1]).alias("o1"))
            for a, b in zip(pts, pts[1:] + pts[:1])
        ]
    )
    x = F.pmod(lon - F.lit(west), F.lit(360.0)) + F.lit(west)

    def hit(e: Column) -> Column:
        straddles = (e["a0"] > lat) != (e["a1"] > lat)
        cut = (e["o1"] - e["o0"]) * (lat - e["a0"]) / (e["a1"] - e["a0"]) + e["o0"]
        return straddles & (x < cut)

    return F.size(F.filter(edges, hit)) % 2 == 1


def in_domain(df: DataFrame, domain: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows within a domain polygon read by :func:`tilequery.sources.tables.read_domain`."""
    from tilequery.session import bounded_rows

    rows = bounded_rows(domain.orderBy("pos").select("lat", "lon"), limit, "domain vertices")
    return df.filter(inside_polygon(F.col("lat"), F.col("lon"), [(r[0], r[1]) for r in rows]))


def outline(df: DataFrame) -> DataFrame:
    """Corner ring of a tile of ``size`` metres centred at ``lat``/``lon`` (small-angle)."""
    half = F.degrees(F.col("size") / F.lit(2.0 * EARTH_RADIUS))
    wide = half / F.cos(F.radians("lat"))
    corner = lambda sy, sx: F.struct(
        (F.col("lat") + F.lit(float(sy)) * half).alias("lat"), (F.col("lon") + F.lit(float(sx)) * wide).alias("lon")
    )
    ring = [corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1)]
    return df.withColumn("outline", F.array(*ring))


def crop_field(field: DataFrame, tiles: DataFrame, cell: float = 0.25) -> DataFrame:
    """Values of a gridded field (``lat, lon, …``) within each tile's box.

    Field points and tiles meet in cells of ``cell`` degrees; a tile lists the cells it
    touches, so candidates exceed the result only along the tiles' edges. Both may lie
    across the date line.
    """
    columns = max(1, round(360.0 / float(cell)))
    step = 360.0 / columns
    half = F.degrees(F.col("size") / F.lit(2.0 * EARTH_RADIUS))
    wide = half / F.cos(F.radians("lat"))
    at = lambda c: F.floor(F.col(c) / F.lit(float(cell)))
    east = lambda c: F.floor((F.col(c) + 180.0) / F.lit(step))
    box = tiles.select(
        "tile_id",
        (F.col("lat") - half).alias("_s"), (F.col("lat") + half).alias("_n"),
        (wrap_lon(F.col("lon")) - F.least(wide, F.lit(180.0))).alias("_w"), (wrap_lon(F.col("lon")) + F.least(wide, F.lit(180.0))).alias("_e"),
    )
    around = F.array_distinct(F.transform(F.sequence(east("_w"), east("_e")), lambda c: F.pmod(c, F.lit(columns))))
    box = box.withColumn("_cy", F.explode(F.sequence(at("_s"), at("_n")))).withColumn("_cx", F.explode(around))
    pts = field.withColumn("lon", wrap_lon(F.col("lon"))).withColumns({"_cy": at("lat"), "_cx": F.pmod(east("lon"), F.lit(columns))})
    # as unwrapped numbers where the box does not cross the date line, so that its closed edges stay exact
    turned = F.col("lon") + F.when(F.col("lon") < F.col("_w"), 360.0).when(F.col("lon") > F.col("_e"), -360.0).otherwise(0.0)
    inside = F.col("lat").between(F.col("_s"), F.col("_n")) & turned.between(F.col("_w"), F.col("_e"))
    return pts.join(box, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy", "_s", "_n", "_w", "_e")
