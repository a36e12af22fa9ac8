"""Tile catalogues: listing files, parsing names, sidecar attributes, caching, integrity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.functions.names import TRIPLET_NAME, file_name, name_matches, parse_name
from tilequery.operators.select import in_order, missing_files


def list_files(spark: SparkSession, root: str, suffix: str = "", recursive: bool = False) -> DataFrame:
    """``path, name, length, modified`` of the files under ``root`` ending in ``suffix``; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(root).select(
        "path", file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified")
    )


def files_in_order(files: DataFrame, name: str = "name") -> DataFrame:
    """A listing or catalogue in order of its file names, with each file's ``place``; equal names by their other columns."""
    return in_order(files, name, *[c for c, kind in files.dtypes if c != name and not kind.startswith(("map", "variant"))])


def list_dirs(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """Directories under ``root`` that hold files, ending in ``suffix``."""
    folder = F.element_at(F.split("path", "/"), -2)
    return list_files(spark, root, recursive=True).select(folder.alias("name")).distinct().filter(F.col("name").endswith(suffix))


def scan_tiles(spark: SparkSession, path: str, fmt: str = TRIPLET_NAME, ext: str = "png", stage: str | None = None) -> DataFrame:
    """Files whose name fits ``fmt``: ``filepath`` (the name) and one typed column per field.

    ``stage`` selects a sub-directory (``train``, ``study``).
    """
    root = f"{path.rstrip('/')}/{stage}" if stage else path
    files = list_files(spark, root, f".{ext}")
    name = F.col("name")
    return files.filter(name_matches(name, fmt, ext)).select(
        name.alias("filepath"), *[c.alias(n) for n, c in parse_name(name, fmt, ext).items()]
    )


def scan_stages(spark: SparkSession, path: str, fmt: str = TRIPLET_NAME, ext: str = "png") -> DataFrame:
    """Tiles of every stage directory, with ``stage`` as a column."""
    files = list_files(spark, path, f".{ext}", recursive=True)
    name = F.col("name")
    return files.filter(name_matches(name, fmt, ext)).select(
        name.alias("filepath"), F.element_at(F.split("path", "/"), -2).alias("stage"),
        *[c.alias(n) for n, c in parse_name(name, fmt, ext).items()],
    )


def attach_sidecar(tiles: DataFrame, sidecar: DataFrame | None, mode: bool | str = "if_available", key: str = "filepath") -> DataFrame:
    """Attributes of a sidecar table. ``False``: none; ``if_available``: NULL where missing; ``True``: all must exist."""
    if not mode:
        return tiles
    if mode == "if_available":
        return tiles if sidecar is None else tiles.join(sidecar, key, "left")
    if mode is not True:
        raise ValueError("mode is False, True or 'if_available'")
    if sidecar is None:
        raise FileNotFoundError("no sidecar table")
    missing = [r[0] for r in tiles.join(sidecar.select(key), key, "left_anti").select(key).take(10)]
    if missing:
        raise FileNotFoundError(f"no sidecar attributes for {missing}")
    return tiles.join(sidecar, key)


def with_aux(tiles: DataFrame, accessor: Callable[[str], dict], schema: str, key: str = "filepath") -> DataFrame:
    """Extra columns from a per-file function, run in batches on the executors."""
    import pandas as pd
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    out = T.StructType(tiles.schema.fields + fields.fields)
    names = [f.name for f in fields.fields]

    def run(batches):
        for pdf in batches:
            extra = pd.DataFrame([accessor(p) for p in pdf[key]], columns=names, index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    return tiles.mapInPandas(run, out)


def cached_catalog(spark: SparkSession, path: str, cache: str, fmt: str = TRIPLET_NAME, ext: str = "png", overwrite: bool = False) -> DataFrame:
    """Stored catalogue, rebuilt when a listed file is missing from it or on ``overwrite``.

    Rows for files that are gone do not make it stale.
    """
    listing = scan_tiles(spark, path, fmt, ext)
    if not overwrite:
        try:
            stored = spark.read.parquet(cache)
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            if missing_files(listing, stored).isEmpty():
                return stored
    listing.write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def verify_files(spark: SparkSession, path: str, expected: DataFrame, suffix: str = "") -> DataFrame:
    """md5 of each file against ``expected (name, md5)``: status ``ok``, ``changed`` or ``missing``.

    Without an expected sum a file only has to exist.
    """
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
        .select(file_name(F.col("path")).alias("name"), F.md5("content").alias("found_md5"))
    )
    status = (
        F.when(F.col("found_md5").isNull(), "missing")
        .when(F.col("md5").isNull() | (F.col("md5") == F.col("found_md5")), "ok")
        .otherwise("changed")
    )
    return expected.join(found, "name", "left").withColumn("status", status)
