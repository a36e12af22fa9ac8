"""Representative tiles: per cluster, on a grid, nearest to given points."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.functions.vectors import distance
from tilequery.operators.select import pick, random_points, top_per_group
from tilequery.schema import require
from tilequery.session import BROADCAST_ROWS, inline_if_small, is_small

METHODS = ("random", "center_dist", "best_triplets", "worst_triplets")


def centroids(df: DataFrame, by: str = "cluster_id", vector: str = "embedding") -> DataFrame:
    """Mean vector and size of each cluster (summed before the shuffle)."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))
    return df.groupBy(by).agg(mean.alias("centroid"), F.count("*").alias("n_tiles"))


def centre_distance(df: DataFrame, by: str = "cluster_id", metric: str = "l1", vector: str = "embedding") -> DataFrame:
    """Distance of each tile to the mean of its cluster."""
    c = inline_if_small(centroids(df, by, vector).select(by, "centroid"))
    return df.join(c, by).withColumn("dist_to_center", distance("centroid", vector, metric)).drop("centroid")


def sample_clusters(df: DataFrame, n: int = 10, method: str = "center_dist", seed: int = 0, by: str = "cluster_id",
                    key: str = "tile_id", metric: str = "l1", vector: str = "embedding") -> DataFrame:
    """``n`` tiles per cluster, ranked from 1; smaller clusters give all they have.

    ``random`` orders by a seeded hash of the id; ``center_dist`` by distance to the
    cluster mean; ``best_triplets``/``worst_triplets`` by anchor–neighbour distance
    (needs the columns ``anchor`` and ``neighbor``). Ties go to the smaller id
    (the larger one for ``worst_triplets``, which reads the same list backwards).
    """
    if method == "random":
        rows, order = df.withColumn("_o", F.xxhash64(F.lit(seed), F.col(key))), ["_o", key]
    elif method == "center_dist":
        rows = centre_distance(df, by, metric, vector)
        order = ["dist_to_center", key]
    elif method in ("best_triplets", "worst_triplets"):
        require(df, "anchor", "neighbor", message="triplet methods need triplet embeddings (anchor, neighbor)")
        rows = df.withColumn("near_dist", distance("anchor", "neighbor", metric))
        asc = method == "best_triplets"
        order = [F.col(c).asc() if asc else F.col(c).desc() for c in ("near_dist", key)]
    else:
        raise NotImplementedError(method)
    return top_per_group(rows, [by], order, n).drop("_o")


def sample_grid(df: DataFrame, dl: float = 0.1, an_dist_max: float = 0.1, x_range: tuple = (-1.0, 1.0), y_range: tuple = (-1.0, 1.0),
                x: str = "x", y: str = "y", key: str = "tile_id") -> DataFrame:
    """For each node of a ``dl`` grid the nearest tile with ``an_dist < an_dist_max``, if nearer than ``dl / 2``.

    A tile within ``dl / 2`` of a node has that node as its rounded position, so
    tiles group by node and no node meets tiles far away. The upper ends of the
    ranges are not nodes.
    """
    def axis(c: str, lo: float, hi: float) -> tuple[Column, int]:
        return F.rint((F.col(c) - F.lit(float(lo))) / F.lit(float(dl))).cast("int"), max(0, math.ceil((hi - lo) / dl))

    ix, nx = axis(x, *x_range)
    iy, ny = axis(y, *y_range)
    near = df.filter(F.col("an_dist") < F.lit(float(an_dist_max))).withColumns({"ix": ix, "iy": iy})
    near = near.filter(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1))
    dx = F.col(x) - (F.lit(float(x_range[0])) + F.col("ix") * F.lit(float(dl)))
    dy = F.col(y) - (F.lit(float(y_range[0])) + F.col("iy") * F.lit(float(dl)))
    near = near.withColumn("node_dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("node_dist") < F.lit(dl / 2.0))
    best = near.groupBy("ix", "iy").agg(F.min(F.struct("node_dist", key)).alias("b"))
    return best.select("ix", "iy", F.col(f"b.{key}").alias(key), F.col("b.node_dist").alias("node_dist"))


def axis_scaling(df: DataFrame, x: str = "x", y: str = "y") -> float:
    """x range divided by y range."""
    r = df.agg(F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    if r[0] is None or not r[1]:
        raise ValueError("x and y need at least two different values")
    return float(r[0]) / float(r[1])


def nearest_tile(df: DataFrame, points: DataFrame, scaling: float = 1.0, x: str = "x", y: str = "y", key: str = "tile_id") -> DataFrame:
    """Nearest tile of each sample point (``point_id, x, y``) in 2-D, y differences times ``scaling``.

    A point list within the broadcast bound goes to the tiles, which keep one
    candidate per point and partition; longer lists use the k-nearest join.
    """
    require(df, key, x, y)
    require(points, "point_id", "x", "y")
    if is_small(points, BROADCAST_ROWS):
        rows = points.select("point_id", F.col("x").cast("double"), F.col("y").cast("double")).collect()
        pid = np.array([r[0] for r in rows], dtype=np.int64)
        px, py = (np.array([r[n] for r in rows], dtype=np.float64) for n in (1, 2))

        def best(batches):
            d = np.full(len(pid), np.inf)
            who = np.zeros(len(pid), dtype=np.int64)
            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                bx, by = (b.column(n).to_numpy(zero_copy_only=False) for n in (1, 2))
                for lo in range(0, len(pid), 64):
                    s = slice(lo, lo + 64)
                    dx = px[s, None] - bx[None, :]
                    dy = (py[s, None] - by[None, :]) * scaling
                    q = np.sqrt(dx * dx + dy * dy)
                    m = q.min(axis=1)
                    w = np.where(q == m[:, None], ids[None, :], np.iinfo(np.int64).max).min(axis=1)
                    better = (m < d[s]) | ((m == d[s]) & (w < who[s]))
                    d[s] = np.where(better, m, d[s])
                    who[s] = np.where(better, w, who[s])
            ok = np.isfinite(d)
            yield pa.RecordBatch.from_arrays([pa.array(pid[ok]), pa.array(who[ok]), pa.array(d[ok])], names=["point_id", key, "dist"])

        tiles = df.select(F.col(key).cast("long"), F.col(x).cast("double"), F.col(y).cast("double")).dropna()
        part = tiles.mapInArrow(best, f"point_id long, {key} long, dist double")
        return part.groupBy("point_id").agg(F.min(F.struct("dist", key)).alias("b")).select(
            "point_id", F.col(f"b.{key}").alias(key), F.col("b.dist").alias("dist")
        )
    from tilequery.operators.knn import knn_join

    s = F.lit(float(scaling))
    left = points.select("point_id", F.array(F.col("x").cast("double"), F.col("y") * s).alias("v"))
    right = df.select(F.col(key).alias("point_id"), F.array(F.col(x).cast("double"), F.col(y) * s).alias("v"))
    return knn_join(left, right, 1, "point_id", "v").select("point_id", F.col("neighbor_id").alias(key), "dist")


def annotate_points(df: DataFrame, points, seed: int = 0, key: str = "tile_id", x: str = "x", y: str = "y") -> DataFrame:
    """Tiles to annotate in a scatter of ``x``/``y``.

    ``points``: a number (random rows, with replacement), a list of ids, or
    ``(xs, ys)`` / ``((xs, x_err), (ys, y_err))`` positions, which take their nearest tile.
    """
    if isinstance(points, int):
        return random_points(df, points, seed, key=key)
    if isinstance(points, list):
        return pick(df, points, key=key)
    if not (isinstance(points, tuple) and len(points) == 2):
        raise NotImplementedError(type(points))
    (xs, xe), (ys, ye) = (p if isinstance(p, tuple) else (p, None) for p in points)
    if len(xs) != len(ys):
        raise ValueError("x and y positions differ in number")
    n = len(xs)
    rows = [
        (i, float(xs[i]), float(ys[i]), float(xe[i]) if xe is not None else None, float(ye[i]) if ye is not None else None)
        for i in range(n)
    ]
    pts = df.sparkSession.createDataFrame(rows, "point_id long, x double, y double, x_err double, y_err double")
    near = nearest_tile(df, pts, axis_scaling(df, x, y), x, y, key)
    pts = pts.withColumnsRenamed({"x": "x_point", "y": "y_point"})
    return pts.join(near, "point_id").join(df, key)
