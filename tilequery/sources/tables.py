"""Stored tables and small metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.schema import EMBEDDINGS, TILE_GEO


def read_embeddings(spark: SparkSession, path: str, stage: str | None = None, schema=EMBEDDINGS) -> DataFrame:
    """Stored embeddings; ``stage`` is a partition filter when the table is laid out by stage."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if stage is None else df.filter(F.col("stage") == stage)


def tile_definitions(spark: SparkSession, path: str, tile_type: str = "anchor", suffix: str = "_meta.yaml") -> DataFrame:
    """lat/lon/size and source files of one tile type, out of the triplets' YAML files."""
    if tile_type not in ("anchor", "neighbor", "distant"):
        raise NotImplementedError(tile_type)

    def parse(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            rows = []
            for name, text in zip(pdf["path"], pdf["value"]):
                meta = yaml.safe_load(text)
                if tile_type == "distant":
                    group, tile = meta["distant"], meta["distant"]["loc"]
                else:
                    group, tile = meta["target"], meta["target"][tile_type]
                file = name.rsplit("/", 1)[-1]
                rows.append(
                    (int(file[: -len(suffix)]), float(tile["lat"]), float(tile["lon"]), float(tile["size"]), list(group["source_files"]))
                )
            yield pd.DataFrame(rows, columns=["tile_id", "lat", "lon", "size", "source_files"])

    texts = (
        spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return texts.mapInPandas(parse, f"tile_id long, {TILE_GEO}")


def read_domain(spark: SparkSession, path: str) -> DataFrame:
    """Polygon file (a YAML list of [lat, lon] pairs) as ``pos, lat, lon``."""

    def parse(batches):
        import pandas as pd
        import yaml

        for pdf in batches:
            for text in pdf["value"]:
                rows = [(n, float(p[0]), float(p[1])) for n, p in enumerate(yaml.safe_load(text))]
                yield pd.DataFrame(rows, columns=["pos", "lat", "lon"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "pos int, lat double, lon double")
