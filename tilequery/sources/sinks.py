"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.functions.names import CROP_NAME, change_suffix, format_name
from tilequery.operators.select import of_type
from tilequery.schema import require


def write_embeddings(df: DataFrame, path: str, partition: str | None = "scene_id", mode: str = "error") -> None:
    """Parquet, laid out by scene (or stage).

    Rows are rebalanced on the partition column first: AQE splits a partition
    value with most of the rows over several tasks, and merges small ones.
    """
    if partition:
        df = df.hint("rebalance", partition)
        df.write.mode(mode).partitionBy(partition).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_crops(crops: DataFrame, path: str, mode: str = "error") -> None:
    """Window crops with the name ``iiiii_jjjjj.png`` built from their centre."""
    require(crops, "scene_id", "i0", "j0", "h", "w", "pixels")
    named = crops.withColumn("name", format_name(CROP_NAME, "png")).withColumn("c", F.lit(3))
    named.write.mode(mode).parquet(path)


def write_catalog_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def export_projector(embs: DataFrame, path: str, tile_type: str = "anchor", mode: str = "overwrite") -> None:
    """Vectors and tile ids of one tile type as two tab-separated tables, both sorted by tile id.

    The n-th line of the vectors (in file order) belongs to the n-th line of the ids.
    """
    line = F.array_join(F.transform("embedding", lambda v: v.cast("string")), "\t").alias("line")
    rows = of_type(embs, tile_type).select("tile_id", line).repartitionByRange("tile_id").sortWithinPartitions("tile_id")
    rows.select("line").write.mode(mode).text(f"{path}/vectors.tsv")
    rows.select(F.col("tile_id").cast("string")).write.mode(mode).option("sep", "\t").csv(f"{path}/metadata.tsv")


def write_clusters(df: DataFrame, path: str, mode: str = "error") -> None:
    """Cluster labels keyed by tile id."""
    require(df, "tile_id", "cluster_id").write.mode(mode).parquet(path)


def save_model(model, path: str) -> None:
    """MLlib model, or a model of this package (its parameters as a Parquet table)."""
    if hasattr(model, "write") and hasattr(model, "uid"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def load_model(spark: SparkSession, directory: str, name: str):
    """Model stored under ``directory/name``; an unknown name lists what is there."""
    from tilequery.operators import manifolds, training  # noqa: F401  (register their models)
    from tilequery.operators.transforms import MODELS

    try:
        kind = spark.read.json(f"{directory}/{name}/kind").first()["kind"]
    except Exception as e:
        found = model_names(spark, directory)
        raise FileNotFoundError(f"no model {name!r} in {directory}; available: {found}") from e
    return MODELS[kind].load(spark, f"{directory}/{name}")


def model_names(spark: SparkSession, directory: str) -> list[str]:
    """Names of the models stored in a directory."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def sidecar_name(df: DataFrame, step: int) -> DataFrame:
    """Name of a scene's stored embeddings: ``.png`` becomes ``.embeddings.{step}_step``."""
    return df.withColumn("embeddings_name", change_suffix(F.col("filepath"), ".png", f".embeddings.{step}_step"))
