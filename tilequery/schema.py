"""Table layouts shared by the sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TILE_TYPES = ("anchor", "neighbor", "distant")

CATALOG = T.StructType(
    [
        T.StructField("triplet_id", T.LongType()),
        T.StructField("tile_type", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

SCENES = T.StructType(
    [
        T.StructField("scene_id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("nx", T.IntegerType()),
        T.StructField("ny", T.IntegerType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("tile_id", T.LongType()),
        T.StructField("tile_type", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("data_dir", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

TRAJECTORIES = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("scene_id", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("traj_id", T.LongType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

#: pixels of one image: rows top to bottom, RGB bytes interleaved
IMAGE_FIELDS = "h int, w int, pixels binary"

TILE_GEO = "lat double, lon double, size double, source_files array<string>"


def require(df: DataFrame, *columns: str, message: str | None = None) -> DataFrame:
    """Fail before any job starts when ``df`` lacks one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(message or f"missing column(s) {missing}; found {df.columns}")
    return df


def require_same(a: DataFrame, b: DataFrame, *columns: str) -> None:
    """Fail unless both tables have ``columns`` with equal types."""
    require(a, *columns)
    require(b, *columns)
    for c in columns:
        if a.schema[c].dataType != b.schema[c].dataType:
            raise ValueError(
                f"column {c!r} differs: {a.schema[c].dataType.simpleString()}"
                f" and {b.schema[c].dataType.simpleString()}"
            )
