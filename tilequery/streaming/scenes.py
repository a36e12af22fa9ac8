"""New scenes in, embeddings out: each scene is worked on once, also across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tilequery.functions.names import file_name
from tilequery.functions.pixels import source_to_rgb
from tilequery.operators import tiling
from tilequery.operators.embed import BATCH, PredictFactory, embed_scenes

#: folders of the table of embeddings
SCENE_PARTS = 64
#: fixed value: row layout of Spark's image source
IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def scene_stream(spark: SparkSession, path: str, kind: str = "image", ext: str = "png", max_files: int | None = None) -> DataFrame:
    """Stream of scene images ``scene_id, h, w, pixels``: picture files, or a Parquet table of decoded scenes."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if kind == "parquet":
        return reader.schema(spark.read.parquet(path).schema).parquet(path)
    if kind != "image":
        raise NotImplementedError(kind)
    raw = reader.format("image").schema(IMAGE_SCHEMA).option("pathGlobFilter", f"*.{ext}").load(path)
    img = F.col("image")
    return raw.select(
        F.regexp_replace(file_name(img["origin"]), r"\.[^.]*$", "").alias("scene_id"),
        img["height"].alias("h"),
        img["width"].alias("w"),
        source_to_rgb(img["height"], img["width"], img["nChannels"], img["data"]).alias("pixels"),
    )


def stream_scenes(scenes: DataFrame, make_predict_fn: PredictFactory, out: str, checkpoint: str, step: tuple[int, int] = tiling.STEP,
                  tile: tuple[int, int] = tiling.TILE, batch_size: int = BATCH, available_now: bool = True) -> StreamingQuery:
    """Start embedding a scene stream into a Parquet table; all rows of a scene lie in one of ``SCENE_PARTS`` folders, ``scene_part``.

    So a batch writes a file per folder, not a file for every task and scene.
    The checkpoint remembers finished files; a restart goes on with the rest.
    ``available_now`` works through what is there and ends.
    """
    rows = embed_scenes(scenes, make_predict_fn, step, tile, batch_size)
    rows = rows.withColumn("scene_part", F.pmod(F.xxhash64("scene_id"), F.lit(SCENE_PARTS)).cast("int")).repartition(SCENE_PARTS, "scene_part")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("scene_part")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
