"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are hung on the smallest of them: the larger ones (large star) or the smaller ones (small star)."""
    both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``edges`` (longs ``a``, ``b``): the smallest node reachable.

    Loops, repeated edges and either direction are allowed; nodes without an edge to another are not returned. Works in
    rounds over tables; nothing but counts reaches the driver. Stops when a round changes nothing.
    """
    now = materialize(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = _sign(now)
    while True:
        now = materialize(_star(_star(now, True), False))
        before, sign = sign, _sign(now)
        if sign == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )


def _sign(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
