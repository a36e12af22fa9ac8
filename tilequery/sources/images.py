"""Image rows from files: tiles and scenes, decoded by Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.functions.names import SCENE_NAME, file_name, name_matches, parse_name
from tilequery.functions.pixels import source_to_rgb
from tilequery.functions.png import salvaged
from tilequery.operators.stats import assert_uniform
from tilequery.session import inline_if_small


def load_images(spark: SparkSession, path: str, ext: str = "png", drop_invalid: bool = False, truncated: bool = False) -> DataFrame:
    """``filepath, h, w, pixels`` (RGB bytes, alpha dropped); undecodable files have NULL size and pixels, or are dropped on request.

    With ``truncated`` a PNG file whose end is missing gives the rows that arrived, the rest black. Files are then read twice, but only names and
    the few broken files' bytes go through a join.
    """
    raw = (
        spark.read.format("image").option("pathGlobFilter", f"*.{ext}").option("dropInvalid", str(drop_invalid and not truncated).lower()).load(path)
    )
    img = F.col("image")
    read = lambda c: F.when(img["nChannels"] > 0, c)
    out = raw.select(
        file_name(img["origin"]).alias("filepath"),
        read(img["height"]).alias("h"),
        read(img["width"]).alias("w"),
        source_to_rgb(*[read(img[c]) for c in ("height", "width", "nChannels", "data")]).alias("pixels"),
    )
    if not truncated:
        return out
    broken = inline_if_small(raw.filter(img["nChannels"] <= 0).select(file_name(img["origin"]).alias("filepath")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path)
    files = files.select(file_name(F.col("path")).alias("filepath"), "content").join(broken, "filepath", "left_semi")
    rescued = files.select("filepath", salvaged("content").alias("s")).select("filepath", "s.h", "s.w", "s.pixels")
    both = out.filter("pixels is not null").unionByName(rescued)
    return both.filter("pixels is not null") if drop_invalid else both


def load_tiles(spark: SparkSession, path: str, tiles: DataFrame, ext: str = "png", truncated: bool = False) -> DataFrame:
    """Catalogue rows with their decoded pixels; a missing or undecodable picture leaves them NULL."""
    return tiles.join(load_images(spark, path, ext, truncated=truncated), "filepath", "left")


def scan_scenes(spark: SparkSession, path: str, fmt: str = SCENE_NAME, ext: str = "png", filter_fn=None) -> DataFrame:
    """Scene images with their size; all must have one shape."""
    raw = spark.read.format("image").option("pathGlobFilter", f"*.{ext}").load(path)
    name = file_name(F.col("image.origin"))
    out = raw.filter(name_matches(name, fmt, ext)).select(
        *[c.alias(n) for n, c in parse_name(name, fmt, ext).items()],
        name.alias("filepath"), F.col("image.width").alias("nx"), F.col("image.height").alias("ny"),
    )
    if filter_fn is not None:
        out = out.transform(filter_fn)
    assert_uniform(out, "nx", "ny")
    return out


def cache_images(images: DataFrame, path: str) -> DataFrame:
    """Decoded images written once; later scans read the stored pixels."""
    images.write.mode("ignore").parquet(path)
    return images.sparkSession.read.parquet(path)
