"""Triplet tables, distances between their parts and triplet losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequery.functions.vectors import distance, norm, squared_distance
from tilequery.operators.select import MAX_BUCKETS, range_buckets, top_per_group
from tilequery.schema import TILE_TYPES, require
from tilequery.session import bounded_rows, inline_if_small, materialize


def triplets(tiles: DataFrame, on_incomplete: str = "error") -> DataFrame:
    """Catalogue pivoted to one row per triplet with struct columns per tile type.

    ``on_incomplete``: ``error`` fails when a part is missing, ``skip`` leaves
    such triplets out.
    """
    if on_incomplete not in ("error", "skip"):
        raise ValueError("on_incomplete must be 'error' or 'skip'")
    require(tiles, "triplet_id", "tile_type", "filepath")
    fields = F.struct(*[c for c in tiles.columns if c not in ("triplet_id", "tile_type")])
    wide = (
        tiles.groupBy(F.col("triplet_id").alias("tile_id"))
        .agg(*[F.first(F.when(F.col("tile_type") == t, fields), ignorenulls=True).alias(t) for t in TILE_TYPES])
    )
    broken = F.lit(False)
    for t in TILE_TYPES:
        broken = broken | F.col(t).isNull()
    if on_incomplete == "error":
        bad = [r[0] for r in wide.filter(broken).select("tile_id").take(10)]
        if bad:
            raise ValueError(f"triplets without all three tiles: {bad}")
    wide = wide.filter(~broken)
    if wide.isEmpty():
        raise FileNotFoundError("no complete triplets found")
    return wide


def singlets(tiles: DataFrame, tile_type: str | None, filter_fn=None) -> DataFrame:
    """Tiles of one type keyed by ``tile_id``; tables of triplets need a type."""
    if tile_type is None and "triplet_id" in tiles.columns:
        raise ValueError("select a tile type when taking single tiles out of triplets")
    out = tiles
    if tile_type is not None:
        out = out.filter(F.col("tile_type") == tile_type.lower()).withColumnRenamed("triplet_id", "tile_id")
    if filter_fn is not None:
        out = out.transform(filter_fn)
    if out.isEmpty():
        raise FileNotFoundError("no tiles found")
    return out


def wide_triplets(embs: DataFrame, *keep: str) -> DataFrame:
    """One row per tile id with the three vectors, in a single shuffle."""
    require(embs, "tile_type", message="triplet embeddings need a tile_type column")
    require(embs, "tile_id", "embedding")
    parts = [
        F.first(F.when(F.col("tile_type") == t, F.col("embedding")), ignorenulls=True).alias(t) for t in TILE_TYPES
    ]
    extra = [F.first(c, ignorenulls=True).alias(c) for c in keep]
    return embs.groupBy("tile_id").agg(*extra, *parts)


def derive_triplets(embs: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """Triplets out of labelled vectors.

    neighbour: the next vector of the same label (the last takes the first);
    distant: the next vector of any other label (else the first of another label).

    Both follow the id sequence, which is cut into buckets of bounded size; a
    bucket's open ends are closed from per-bucket heads. So neither the whole
    sequence nor a label with most of the rows is ever sorted by one task.
    """
    ids, n_buckets = range_buckets(embs.select(key, label), key)
    in_label = Window.partitionBy(label, "_b").orderBy(key)
    heads = ids.groupBy(label, "_b").agg(F.min(key).alias("_head"))
    along = Window.partitionBy(label).orderBy("_b")
    heads = heads.select(
        label, "_b",
        F.coalesce(F.lead("_head").over(along), F.min("_head").over(Window.partitionBy(label))).alias("_wrap"),
        F.min("_head").over(Window.partitionBy(label)).alias("_first"),
    )
    heads = materialize(heads)
    in_bucket = Window.partitionBy("_b").orderBy(key)
    reverse = Window.partitionBy("_b").orderBy(F.desc(key))
    turn = F.when(F.lead(label).over(in_bucket) != F.col(label), F.lead(key).over(in_bucket))
    rows = (
        ids.withColumn("_nid", F.lead(key).over(in_label))
        .withColumn("_turn", turn)
        # the next turn is the last one seen in reverse order (a growing frame, one step per row)
        .withColumn("_did", F.last("_turn", ignorenulls=True).over(reverse.rowsBetween(Window.unboundedPreceding, 0)))
    )
    rows = rows.join(inline_if_small(heads.select(label, "_b", "_wrap")), [label, "_b"])
    if n_buckets > 1:
        rows = rows.join(_heads_of_others(ids, key, label), [label, "_b"], "left").withColumn("_did", F.coalesce("_did", "_other"))
    rows = rows.join(_first_of_another_label(heads.select(label, "_first").distinct(), label), label, "left")
    links = rows.select(key, F.coalesce("_nid", "_wrap").alias("_nid"), F.coalesce("_did", "_else").alias("_did"))
    vec = lambda name, out: embs.select(F.col(key).alias(name), F.col("embedding").alias(out))
    return (
        embs.join(links, key)
        .join(vec("_nid", "neighbor"), "_nid")
        .join(vec("_did", "distant"), "_did")
        .select(F.col(key).alias("tile_id"), label, F.col("embedding").alias("anchor"), "neighbor", "distant")
    )


def _heads_of_others(ids: DataFrame, key: str, label: str) -> DataFrame:
    """``label, _b, _other``: for the label a bucket ends with, the first id of another label in a later bucket.

    Works on the first ids per (bucket, label) of at most ``MAX_BUCKETS`` buckets,
    of which the two smallest per bucket are enough.
    """
    first = ids.groupBy("_b", label).agg(F.min(key).alias("_h"))
    two = top_per_group(first, ["_b"], ["_h"], 2).orderBy("_b", "rank")
    last = {r["_b"]: r["l"] for r in bounded_rows(ids.groupBy("_b").agg(F.max_by(label, key).alias("l")), MAX_BUCKETS, "buckets")}
    opening: dict[int, list] = {}
    for r in bounded_rows(two, 2 * MAX_BUCKETS, "bucket heads"):
        opening.setdefault(r["_b"], []).append((r[label], r["_h"]))
    found, later = [], []  # walk back; later holds the heads of the buckets behind, nearest first
    for b in sorted(last, reverse=True):
        hit = next((h for lab, h in later if lab != last[b]), None)
        found.append((last[b], b, hit))
        # only the nearest head and the nearest of another label can ever be asked for
        heads = opening[b] + later
        later = heads[:1] + [h for h in heads[1:] if h[0] != heads[0][0]][:1]
    kind = ids.schema[label].dataType.simpleString()
    return F.broadcast(ids.sparkSession.createDataFrame(found, f"{label} {kind}, _b int, _other long"))


def _first_of_another_label(firsts: DataFrame, label: str) -> DataFrame:
    """``label, _else``: the smallest id under any other label, from the two smallest label heads."""
    two = firsts.orderBy("_first").take(2)
    if len(two) < 2:
        return firsts.select(label, F.lit(None).cast("long").alias("_else"))
    other = F.when(F.col(label) == F.lit(two[0][label]), F.lit(two[1]["_first"])).otherwise(F.lit(two[0]["_first"]))
    return inline_if_small(firsts.select(label, other.alias("_else")))


def triplet_distances(wide: DataFrame) -> DataFrame:
    """Squared anchor–neighbour and anchor–distant distances."""
    require(wide, *TILE_TYPES)
    return wide.withColumns(
        {
            "l_near": squared_distance("anchor", "neighbor"),
            "l_distant": squared_distance("anchor", "distant"),
        }
    ).drop(*TILE_TYPES)


def triplet_loss(wide: DataFrame, margin: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Mean hinge loss on squared distances and the two mean distances."""
    d = triplet_distances(wide)
    hinge = F.greatest(F.col("l_near") - F.col("l_distant") + F.lit(float(margin)), F.lit(0.0))
    return d.groupBy(*(by or [])).agg(
        F.avg(hinge).alias("loss"),
        F.avg("l_near").alias("l_near"),
        F.avg("l_distant").alias("l_distant"),
    )


def triplet_loss_norm(wide: DataFrame, margin: float = 1.0, l2: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Older loss: unsquared distances plus ``l2`` times the Frobenius norms of the three batches."""
    near, far = distance("anchor", "neighbor"), distance("anchor", "distant")
    d = wide.withColumns(
        {"_n": near, "_d": far, **{f"_q_{t}": F.pow(norm(t), F.lit(2.0)) for t in TILE_TYPES}}
    )
    penalty = F.lit(0.0)
    for t in TILE_TYPES:
        penalty = penalty + F.sqrt(F.sum(f"_q_{t}"))
    hinge = F.avg(F.greatest(F.col("_n") - F.col("_d") + F.lit(float(margin)), F.lit(0.0)))
    return d.groupBy(*(by or [])).agg(
        (hinge + F.lit(float(l2)) * penalty).alias("loss"),
        F.avg("_n").alias("l_near"),
        F.avg(-F.col("_d")).alias("l_distant"),
    )


def pair_distance(wide: DataFrame, a: str = "anchor", b: str = "neighbor", metric: str = "l2", name: str = "an_dist") -> DataFrame:
    """Distance between two parts of each triplet."""
    return require(wide, a, b).withColumn(name, distance(a, b, metric))


def zip_types(tiles: DataFrame) -> DataFrame:
    """Files of each type zipped by position in name order; unequal counts are an error."""
    from tilequery.operators.select import numbered

    counts = {r["tile_type"]: r["count"] for r in tiles.groupBy("tile_type").count().take(100)}
    if set(counts) != set(TILE_TYPES) or len(set(counts.values())) != 1:
        raise ValueError(f"unequal file counts per tile type: {counts}")
    n = counts["anchor"]
    rows = numbered(tiles.select("tile_type", "filepath"), "tile_type", "filepath", name="_r")
    # the types follow each other in the numbering, each with n files
    return (
        rows.withColumn("pos", F.col("_r") % n)
        .groupBy("pos")
        .agg(*[F.first(F.when(F.col("tile_type") == t, F.col("filepath")), ignorenulls=True).alias(t) for t in TILE_TYPES])
    )
