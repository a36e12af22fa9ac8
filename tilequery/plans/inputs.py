"""The given tables seen as tiles, triplets, scenes, images and trajectories.

Each Spark view has its SQL text next to it, used by the reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequery.operators.triplets import derive_triplets


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """``tile_id, label, embedding``."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id"), "label", "embedding")


EMB = "emb as (select vec_id as tile_id, label, embedding from embeddings)"


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Triplets ``tile_id, label, anchor, neighbor, distant`` derived from labelled vectors."""
    return derive_triplets(table(spark, sf, "embeddings"))


WIDE = """nb as (select vec_id, coalesce(lead(vec_id) over (partition by label order by vec_id),
                                        min(vec_id) over (partition by label)) nid from embeddings),
     di as (select a.vec_id, coalesce(min(case when b.vec_id > a.vec_id then b.vec_id end), min(b.vec_id)) did
            from embeddings a join embeddings b on a.label <> b.label group by a.vec_id),
     wide as (select a.vec_id tile_id, a.label, a.embedding::double[] anchor, n.embedding::double[] neighbor,
                     d.embedding::double[] distant
              from embeddings a join nb on a.vec_id = nb.vec_id join di on a.vec_id = di.vec_id
              join embeddings n on n.vec_id = nb.nid join embeddings d on d.vec_id = di.did),
     dist as (select tile_id, label, list_distance(anchor, neighbor) an_dist, list_distance(anchor, distant) ad_dist from wide)"""


def long(spark: SparkSession, sf: str) -> DataFrame:
    """Triplet embeddings, one row per tile type."""
    w = wide(spark, sf)
    parts = F.explode(
        F.array(*[F.struct(F.lit(t).alias("tile_type"), F.col(t).alias("embedding")) for t in ("anchor", "neighbor", "distant")])
    )
    return w.withColumn("_p", parts).select("tile_id", "label", "_p.tile_type", "_p.embedding")


def flat(spark: SparkSession, sf: str) -> DataFrame:
    """Points of a plane: the first two components, with the anchor–neighbour distance."""
    from tilequery.operators.triplets import pair_distance

    w = pair_distance(wide(spark, sf))
    c = lambda k: F.get(F.col("anchor"), F.lit(k)).cast("double")
    return w.select("tile_id", "label", c(0).alias("x"), c(1).alias("y"), "an_dist")


FLAT = WIDE + """,
     flat as (select w.tile_id, w.label, anchor[1] x, anchor[2] y, an_dist from wide w join dist using (tile_id))"""


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles laid out on a scene per label: ``scene_id, i0, j0, tile_id, embedding``."""
    from tilequery.operators.select import numbered
    from tilequery.session import inline_if_small

    rows = numbered(embeddings(spark, sf), "label", "tile_id", name="_r")
    first = inline_if_small(rows.groupBy("label").agg(F.min("_r").alias("_f")))
    rn = F.col("_r") - F.col("_f")
    return rows.join(first, "label").select(
        F.col("label").alias("scene_id"),
        (F.lit(128) + 50 * (rn % 8)).cast("int").alias("i0"),
        (F.lit(128) + 50 * F.floor(rn / 8)).cast("int").alias("j0"),
        "tile_id",
        "embedding",
    )


GRID = """g as (select label scene_id, (128 + 50 * (rn % 8))::int i0, (128 + 50 * (rn // 8))::int j0, vec_id tile_id,
                       embedding::double[] embedding
                from (select *, row_number() over (partition by label order by vec_id) - 1 rn from embeddings))"""


def with_xy(grid: DataFrame) -> DataFrame:
    """Metre coordinates of gridded tiles."""
    return grid.withColumns({"x": F.col("i0") * 1000.0, "y": F.col("j0") * 500.0})


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """One scene of 600 x 400 pixels per customer."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("scene_id"),
        F.concat("c_name", F.lit(".png")).alias("filepath"),
        F.lit(600).alias("nx"),
        F.lit(400).alias("ny"),
    )


def trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """``event_id, traj_id, time, prefix, x, y``; values above 250 lie outside the image."""
    e = table(spark, sf, "events")
    ok = F.col("value") <= 250
    return e.select(
        "event_id",
        F.col("user_id").alias("traj_id"),
        F.col("ts").alias("time"),
        F.col("event_type").alias("prefix"),
        F.when(ok, F.col("value")).alias("x"),
        F.when(ok, F.get_json_object("props", "$.k").cast("double")).alias("y"),
    )


TRAJ = """t as (select event_id, user_id traj_id, ts as time, event_type prefix,
                       case when value <= 250 then value end x,
                       case when value <= 250 then json_extract_string(props, '$.k')::double end y from events)"""


def images(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 pictures drawn from the vectors: ``tile_id, label, h, w, pixels``."""

    @F.arrow_udf("binary")
    def draw(v):
        import numpy as np
        import pyarrow as pa

        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        level = np.clip(np.floor(127.5 + 500.0 * x), 0, 255).astype(np.uint8)
        rgb = np.stack([np.roll(level, -21 * c, axis=1) for c in range(3)], axis=2)
        return pa.array([row.tobytes() for row in rgb], pa.binary())

    return embeddings(spark, sf).select(
        "tile_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), draw("embedding").alias("pixels")
    )


#: one row per pixel: tile, position, r, g, b
PIXELS = """lv as (select vec_id tile_id, label,
                        list_transform(embedding, lambda v: least(greatest(floor(127.5 + 500.0 * v::double), 0), 255)) l
                 from embeddings),
     px as (select tile_id, label, p::int p, l[p + 1] r, l[(p + 21) % 64 + 1] g, l[(p + 42) % 64 + 1] b
            from lv, range(64) q(p))"""


def page_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Scene pictures out of the whole bytes of web pages: 32 pixels wide, padded to full rows."""
    raw = F.encode(F.col("html"), "UTF-8")
    rows = F.greatest(F.ceil(F.octet_length(raw) / 96).cast("int"), F.lit(1))
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("scene_id"),
        rows.alias("h"),
        F.lit(32).alias("w"),
        F.rpad(raw, rows * 96, F.lit(b"\x00")).alias("pixels"),
    )


#: hex text of each page picture, two digits per byte
PAGE_HEX = """pg as (select page_id scene_id, greatest(ceil(octet_length(encode(html)) / 96.0), 1)::int h,
                            hex(encode(html)) raw from pages),
     pic as (select scene_id, h, rpad(raw, h * 192, '0') hx from pg)"""
