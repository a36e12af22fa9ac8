"""Trajectory tables: geo lookup, time windows, as-of scenes, frame pairing and linking."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequery.functions.names import parse_scene_id
from tilequery.operators.select import numbered
from tilequery.schema import require
from tilequery.session import inline_if_small, materialize

# --- values carried along a sorted sequence, split over range partitions ------


def _carried(df: DataFrame, order: list[str], value: str, before: str, after: str) -> DataFrame:
    """Last non-NULL ``value`` up to each row and first from it on, in global order.

    Sorted range partitions are filled inside; between partitions only one row
    each travels, so neither a long gap nor a hot key ends up in one task.
    """
    df = df.withColumn("_h", F.xxhash64(*df.columns))  # splits rows of one and the same place
    order = [*order, "_h"]
    parts = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    # looking ahead is looking back in the reverse order: growing frames cost one step per row,
    # shrinking ones are recomputed for every row
    back = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("_p").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    filled = parts.withColumns(
        {"_b": F.last(value, ignorenulls=True).over(back), "_a": F.last(value, ignorenulls=True).over(ahead)}
    )
    place, known = F.struct(*order), F.col(value).isNotNull()
    edges = parts.groupBy("_p").agg(
        F.max_by(F.when(known, F.col(value)), F.when(known, place)).alias("_l"),
        F.min_by(F.when(known, F.col(value)), F.when(known, place)).alias("_f"),
    )
    before_p = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    after_p = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "_p", F.last("_l", ignorenulls=True).over(before_p).alias("_pb"), F.last("_f", ignorenulls=True).over(after_p).alias("_pa")
    )
    out = filled.join(inline_if_small(edges), "_p")
    out = out.withColumns({before: F.coalesce("_b", "_pb"), after: F.coalesce("_a", "_pa")})
    return out.drop("_p", "_h", "_b", "_a", "_pb", "_pa")


# --- geo lookup ---------------------------------------------------------------


def clean_points(points: DataFrame, nx: int | Column, ny: int | Column, flip_y: bool = True) -> DataFrame:
    """Round half-even, flip y, and make missing or out-of-image points NULL in both indices."""
    nx = nx if isinstance(nx, Column) else F.lit(nx)
    ny = ny if isinstance(ny, Column) else F.lit(ny)

    def whole(c: str) -> Column:
        v = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
        return F.rint(F.coalesce(v, F.lit(-1.0))).cast("int")

    i = whole("i")
    j = (ny - 1 - whole("j")) if flip_y else whole("j")
    out = points.withColumns({"_i": i, "_j": j})
    bad = (F.col("_i") < 0) | (F.col("_i") >= nx) | (F.col("_j") < 0) | (F.col("_j") >= ny)
    return out.withColumns(
        {
            "i": F.when(bad, F.lit(None)).otherwise(F.col("_i")).cast("int"),
            "j": F.when(bad, F.lit(None)).otherwise(F.col("_j")).cast("int"),
        }
    ).drop("_i", "_j")


def attach_geo(points: DataFrame, xs: DataFrame, ys: DataFrame, latlon: DataFrame | None = None) -> DataFrame:
    """x by (scene, i), y by (scene, j), lat/lon by (scene, i, j); invalid points get NULL."""
    ok = F.col("i").isNotNull() & F.col("j").isNotNull()
    out = points.join(xs.select("scene_id", "i", "x"), ["scene_id", "i"], "left").join(
        ys.select("scene_id", "j", "y"), ["scene_id", "j"], "left"
    )
    if latlon is not None:
        out = out.join(latlon.select("scene_id", "i", "j", "lat", "lon"), ["scene_id", "i", "j"], "left")
    for c in ("x", "y", "lat", "lon"):
        if c in out.columns:
            out = out.withColumn(c, F.when(ok, F.col(c)))
    return out


def points_of_scenes(points: DataFrame, scenes: DataFrame) -> DataFrame:
    """Trajectory points with the attributes of their scene."""
    return points.join(scenes, "scene_id")


def union_trajectories(*dfs: DataFrame, pattern: str | None = None, time_format: str | None = None) -> DataFrame:
    """Trajectories of several groups as one table; time is read from the scene id when missing."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    if "time" not in out.columns:
        kw = {k: v for k, v in (("pattern", pattern), ("time_format", time_format)) if v is not None}
        prefix, time = parse_scene_id(F.col("scene_id"), **kw)
        out = out.withColumn("time", time)
        if "prefix" not in out.columns:
            out = out.withColumn("prefix", prefix)
    return out


# --- time windows -------------------------------------------------------------


def _micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp (with or without zone, session zone UTC)."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def trajectory_window(points: DataFrame, scenes: DataFrame, dt_minutes: float = 120, key: str = "traj_id", at: str = "time") -> DataFrame:
    """Parts of each trajectory within ``[t - dt, t]`` and ``[t, t + dt]`` of each scene time.

    ``scenes`` has ``key``, ``scene_id`` and ``at``. Both sides meet in time buckets of
    width ``dt``, so a long trajectory is never paired with itself as a whole. Parts
    of a single point are left out; ``part`` is ``past`` or ``future``.
    """
    require(points, key, at)
    require(scenes, key, "scene_id", at)
    dt = int(dt_minutes * 60_000_000)
    bucket = F.floor(_micros(at) / F.lit(dt))
    left = scenes.select(
        key, "scene_id", F.col(at).alias("_t"), _micros(at).alias("_s"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"),
    )
    right = points.withColumns({"_b": bucket, "_q": _micros(at)})
    if "scene_id" in points.columns:
        right = right.drop("scene_id")
    near = left.join(right, [key, "_b"]).filter(F.abs(F.col("_q") - F.col("_s")) <= dt)
    parts = F.array_compact(
        F.array(F.when(F.col("_q") <= F.col("_s"), F.lit("past")), F.when(F.col("_q") >= F.col("_s"), F.lit("future")))
    )
    # stored, since the parts are counted and then picked: the join runs once
    rows = materialize(near.withColumn("part", F.explode(parts)).withColumnRenamed("_t", "scene_time").drop("_b", "_q", "_s"))
    keep = rows.groupBy("scene_id", key, "part").agg(F.count("*").alias("n_points")).filter(F.col("n_points") > 1)
    return rows.join(keep, ["scene_id", key, "part"])


def window_counts(points: DataFrame, dt_minutes: float = 120, key: str = "traj_id", at: str = "time", row: str = "event_id") -> DataFrame:
    """Number of points of the same trajectory in ``[t - dt, t]`` and ``[t, t + dt]`` of each point.

    Range frames over buckets of eight ``dt``; rows near a bucket's edge are also
    given to the neighbouring bucket, so a hot trajectory is split and the counts
    stay exact.
    """
    dt = int(dt_minutes * 60_000_000)
    width = 8 * dt
    t = _micros(at)
    b = F.floor(t / F.lit(width))
    inside = t - b * width
    home = F.struct(b.alias("_b"), F.lit(True).alias("_own"))
    before = F.when(inside <= dt, F.struct((b - 1).alias("_b"), F.lit(False).alias("_own")))
    after = F.when(inside >= width - dt, F.struct((b + 1).alias("_b"), F.lit(False).alias("_own")))
    rows = points.withColumn("_t", t).withColumn("_c", F.explode(F.array_compact(F.array(home, before, after))))
    w = Window.partitionBy(key, "_c._b").orderBy("_t")
    return (
        rows.withColumns(
            {
                "n_past": F.count("*").over(w.rangeBetween(-dt, 0)),
                "n_future": F.count("*").over(w.rangeBetween(0, dt)),
            }
        )
        .filter("_c._own")
        .drop("_t", "_c")
    )


def trajectory_overlay(points: DataFrame, scenes: DataFrame, dt_minutes: float = 120, key: str = "traj_id", at: str = "time") -> DataFrame:
    """Past and future parts plus the point at the scene time itself (``part = 'point'``)."""
    parts = trajectory_window(points, scenes, dt_minutes, key, at)
    cols = ["scene_id", key, "part", at, "x", "y"]
    here = scenes.select(key, "scene_id", at).join(points.select(key, at, "x", "y"), [key, at])
    return parts.select(*cols).unionByName(here.withColumn("part", F.lit("point")).select(*cols))


def asof_scene(samples: DataFrame, scenes: DataFrame, tolerance_minutes: float | None = None, at: str = "time") -> DataFrame:
    """Nearest scene in time for each sample (the earlier one on a tie); NULL outside the tolerance."""
    empty = F.lit(None).cast(scenes.schema["scene_id"].dataType)
    sc = scenes.select(
        F.col(at), F.struct(F.col(at).alias("time"), F.col("scene_id").alias("scene_id")).alias("_scene"), F.lit(0).alias("_kind")
    )
    blank = F.lit(None).cast(sc.schema["_scene"].dataType)
    rows = samples.withColumns({"_scene": blank, "_kind": F.lit(1)})
    both = rows.unionByName(sc, allowMissingColumns=True)
    # scenes sort before samples of the same time: such a scene counts as earlier, and wins
    later = _carried(both, [at, "_kind", "_scene"], "_scene", "_before", "_after")
    rows = later.filter(F.col("_kind") == 1)
    gap_b = F.col(f"{at}_us") - F.unix_micros(F.col("_before.time").cast("timestamp"))
    gap_a = F.unix_micros(F.col("_after.time").cast("timestamp")) - F.col(f"{at}_us")
    rows = rows.withColumn(f"{at}_us", _micros(at)).withColumns({"_gb": gap_b, "_ga": gap_a})
    before_wins = F.col("_ga").isNull() | (F.col("_gb") <= F.col("_ga"))
    chosen = F.when(before_wins & F.col("_gb").isNotNull(), F.col("_before.scene_id")).otherwise(F.col("_after.scene_id"))
    gap = F.when(before_wins & F.col("_gb").isNotNull(), F.col("_gb")).otherwise(F.col("_ga"))
    if tolerance_minutes is not None:
        chosen = F.when(gap <= int(tolerance_minutes * 60_000_000), chosen).otherwise(empty)
    return rows.withColumns({"nearest_scene": chosen, "gap_us": gap}).drop(
        "_scene", "_kind", "_before", "_after", "_gb", "_ga", f"{at}_us"
    )


# --- frames -------------------------------------------------------------------


def frames(points: DataFrame, prefix: str = "prefix", at: str = "time") -> DataFrame:
    """One row per (prefix, time) with its number of valid points and the frame before it."""
    per = points.groupBy(prefix, at).agg(F.count("x").alias("n_points"))
    return previous_frame(per, prefix, at)


def previous_frame(df: DataFrame, prefix: str = "prefix", at: str = "time") -> DataFrame:
    """``prev_time``: the time of the preceding row of the same prefix.

    Done by dense numbering and a self join on ``row - 1``, so that one prefix
    with most of the frames is still spread.
    """
    rows = materialize(numbered(df, prefix, at, name="_r"))
    before = rows.select((F.col("_r") + 1).alias("_r"), F.col(prefix).alias("_pp"), F.col(at).alias("_pt"))
    return (
        rows.join(before, "_r", "left")
        .withColumn(f"prev_{at}", F.when(F.col("_pp") == F.col(prefix), F.col("_pt")))
        .drop("_r", "_pp", "_pt")
    )


def trim_leading(frame_counts: DataFrame, min_points: int = 100, prefix: str = "prefix", at: str = "time") -> DataFrame:
    """Drop the frames of each prefix before the first one with ``min_points`` points."""
    start = frame_counts.groupBy(prefix).agg(F.min(F.when(F.col("n_points") >= min_points, F.col(at))).alias("_start"))
    return frame_counts.join(inline_if_small(start), prefix).filter(F.col(at) >= F.col("_start")).drop("_start")


def by_prefix(points: DataFrame, fn, prefix: str = "prefix") -> DataFrame:
    """Apply a DataFrame function that works per prefix (it must keep ``prefix`` in its keys)."""
    out = points.transform(fn)
    return require(out, prefix)


def link_points(points: DataFrame, max_displacement: float, prefix: str = "prefix", frame: str = "frame", point: str = "point_id") -> DataFrame:
    """Points of each frame linked one-to-one to the next frame (``frame + 1``).

    A link joins two points that are each other's nearest within the maximum
    displacement (ties: smaller id).
    """
    from tilequery.operators import knn

    # of several points in one place the smallest id is the nearest to anything, so only it can be linked
    place = points.filter("x is not null and y is not null").groupBy(F.col(prefix).alias("_g"), F.col(frame).alias("_f"), "x", "y")
    spots = materialize(place.agg(F.min(point).alias("id")))
    r = float(max_displacement)
    cell = {"cx": F.floor(F.col("x") / r), "cy": F.floor(F.col("y") / r)}
    meet = ["_g", "_f", "cx", "cy"]
    here = spots.withColumns(cell)
    first, second = spots.select("_g", "_f", "id", "x", "y"), spots.select("_g", (F.col("_f") - 1).alias("_f"), "id", "x", "y")
    most = math.isqrt(knn.CELL_PAIRS)
    if here.groupBy(*meet).count().filter(F.col("count") > most).isEmpty() and not knn.crowded(first, second, ["_g", "_f"], r):
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        ahead = here.withColumn("_o", around).select(
            "_g", "_f", (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"), "id", "x", "y"
        )
        later = here.select("_g", (F.col("_f") - 1).alias("_f"), "cx", "cy", F.col("id").alias("near_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        gap = F.sqrt((F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")))
        # stored, since both directions look at the pairs
        pairs = materialize(ahead.join(later, meet).select("_g", "_f", "id", "near_id", gap.alias("dist")).filter(F.col("dist") <= r))
        fwd = pairs.groupBy("_g", "_f", "id").agg(F.min(F.struct("dist", "near_id")).alias("b")).select("_g", "_f", "id", "b.near_id", "b.dist")
        back = pairs.groupBy("_g", "_f", "near_id").agg(F.min(F.struct("dist", "id")).alias("b")).select("_g", "_f", "near_id", "b.id")
    else:  # crowded cells: the nearest of each point is looked for from short distances on
        fwd = knn.nearest_within(first, second, ["_g", "_f"], r).drop("x", "y")
        back = knn.nearest_within(second, first, ["_g", "_f"], r).select("_g", "_f", F.col("id").alias("near_id"), F.col("near_id").alias("id"))
    return fwd.join(back, ["_g", "_f", "id", "near_id"]).select(
        F.col("_g").alias(prefix), F.col("_f").alias(frame), F.col("id").alias(point), F.col("near_id").alias("next_id"), F.col("dist").alias("displacement")
    )
