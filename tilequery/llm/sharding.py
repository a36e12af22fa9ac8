"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequery.session import materialize

#: records numbered together when slots are given out
SLOT_ROWS = 50_000


def unit_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) from a key and a shard: the first 48 bits of an MD5, so that any engine can recompute it."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the best score of a key; a new shard takes keys only into itself.

    The score of shard s is ``-ln(u(key, s)) / weight(s)``; the smallest wins, so shares follow the
    weights. A weight of 0 leaves a shard empty. Equal scores go to the smaller shard; a null key is the empty key.
    """
    live = [(i, w) for i, w in enumerate(weights) if w > 0]
    if not live or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative, one of them positive")
    scores = [F.struct((-F.ln(unit_hash(key, i)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in live]
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def assign_shards(df: DataFrame, key: str, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """``df`` with ``shard`` and, where ``grown`` weights are given, ``grown_shard``.

    The key and the weights alone decide, so equal keys meet in one shard and a change of the shards moves no
    more keys than it must. Rows are kept as they are; an empty table stays empty.
    """
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    return out.withColumn("grown_shard", rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int"))


def number_slots(df: DataFrame, order: list[str], shard: str = "shard", rows: int = SLOT_ROWS) -> DataFrame:
    """``df`` with ``slot``: gapless numbers from 0 within each shard.

    Records are dealt to buckets of about ``rows`` by a hash of ``order``; a bucket is numbered on its own and shifted
    by the sizes of the buckets before it, so no task holds a shard. Rows equal in ``order`` get slots in any order.
    """
    held = materialize(df.withColumn("_all", F.xxhash64(*order)))
    n = held.count()
    buckets = max(1, -(-n // rows))
    held = held.withColumn("_bucket", F.pmod(F.col("_all"), F.lit(buckets)).cast("int")).drop("_all")
    sizes = held.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = held.withColumn("_r", F.row_number().over(inner) - 1)
    joined = numbered.join(sizes, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_before") + F.col("_r")).cast("long")).drop("_s", "_b", "_bucket", "_r", "_before")


def shard_report(df: DataFrame) -> DataFrame:
    """Rows and bytes per shard, and how many rows one more shard would move."""
    moved = reduce(lambda a, b: a & b, [F.col("grown_shard").isNotNull(), F.col("grown_shard") != F.col("shard")])
    return df.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum(moved.cast("long")).alias("moved"))
