"""Trajectories over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequery.operators import trajectories as tr
from tilequery.plans import inputs
from tilequery.plans.inputs import TRAJ
from tilequery.plans.registry import query
from tilequery.plans.triplet_queries import _r


@query(
    "points_cleaned",
    f"""with {TRAJ}, r as (select event_id, round_even(coalesce(x, -1), 0)::int i, 99 - round_even(coalesce(y, -1), 0)::int j from t)
        select event_id, case when i >= 0 and i < 200 and j >= 0 and j < 100 then i end i, case when i >= 0 and i < 200 and j >= 0 and j < 100 then j end j from r""",
)
def points_cleaned(spark, sf):
    p = inputs.trajectories(spark, sf).select("event_id", F.col("x").alias("i"), F.col("y").alias("j"))
    return tr.clean_points(p, 200, 100)


def _pixel_points(spark, sf):
    t = inputs.trajectories(spark, sf)
    p = t.select("event_id", F.col("prefix").alias("scene_id"), F.col("x").alias("i"), F.col("y").alias("j"))
    return tr.clean_points(p, 200, 100, flip_y=False)


def _grid(spark, sf):
    s = inputs.trajectories(spark, sf).select(F.col("prefix").alias("scene_id")).distinct()
    xs = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("x", F.col("i") * 2.0)
    ys = s.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("y", F.col("j") * 3.0)
    ll = xs.join(ys, "scene_id").select("scene_id", "i", "j", (F.col("j") / 10 + 5).alias("lat"), (F.col("i") / 10 - 60).alias("lon"))
    return xs, ys, ll


@query(
    "points_with_geo",
    f"""with {TRAJ}, r as (select event_id, prefix scene_id, round_even(coalesce(x, -1), 0)::int i, round_even(coalesce(y, -1), 0)::int j from t),
        c as (select event_id, scene_id, case when i between 0 and 199 and j between 0 and 99 then i end i, case when i between 0 and 199 and j between 0 and 99 then j end j from r)
        select event_id, scene_id, i, j, i * 2.0::double x, j * 3.0::double y, round(j / 10 + 5, 6) lat, round(i / 10 - 60, 6) lon from c""",
)
def points_with_geo(spark, sf):
    out = tr.attach_geo(_pixel_points(spark, sf), *_grid(spark, sf))
    return out.select("event_id", "scene_id", "i", "j", "x", "y", _r("lat"), _r("lon"))


@query(
    "points_with_scene",
    f"""with {TRAJ}, s as (select prefix, count(*) n from t group by prefix) select event_id, prefix scene_id, n from t join s using (prefix)""",
)
def points_with_scene(spark, sf):
    t = inputs.trajectories(spark, sf).withColumnRenamed("prefix", "scene_id")
    s = t.groupBy("scene_id").agg(F.count("*").alias("n"))
    return tr.points_of_scenes(t.select("event_id", "scene_id"), s)


def _scene_times(spark, sf):
    """Every purchase counts as a scene of its trajectory."""
    t = inputs.trajectories(spark, sf).filter("prefix = 'purchase'")
    return t.select("traj_id", "time", F.col("event_id").alias("scene_id"))


PARTS = f"""{TRAJ}, s as (select traj_id, time st, event_id scene_id from t where prefix = 'purchase'),
     p as (select scene_id, traj_id, part, event_id, time, x, y from s join t using (traj_id), (values ('past'), ('future')) k(part)
           where (part = 'past' and time between st - interval 120 minute and st) or (part = 'future' and time between st and st + interval 120 minute)),
     n as (select scene_id, traj_id, part, count(*) n_points from p group by all having count(*) > 1)"""


@query("trajectory_parts", f"with {PARTS} select scene_id, traj_id, part, event_id, n_points from p join n using (scene_id, traj_id, part)")
def trajectory_parts(spark, sf):
    t = inputs.trajectories(spark, sf).select("event_id", "traj_id", "time", "x", "y")
    out = tr.trajectory_window(t, _scene_times(spark, sf), 120)
    return out.select("scene_id", "traj_id", "part", "event_id", "n_points")


@query(
    "trajectory_overlay",
    f"""with {PARTS} select scene_id, traj_id, part, time, x, y from p join n using (scene_id, traj_id, part)
        union all select event_id, traj_id, 'point', time, x, y from t where prefix = 'purchase'""",
)
def trajectory_overlay(spark, sf):
    t = inputs.trajectories(spark, sf).select("event_id", "traj_id", "time", "x", "y")
    return tr.trajectory_overlay(t, _scene_times(spark, sf), 120)


@query(
    "points_near_in_time",
    f"""with {TRAJ} select event_id, count(*) over (partition by traj_id order by time range between interval 120 minute preceding and current row) n_past,
        count(*) over (partition by traj_id order by time range between current row and interval 120 minute following) n_future from t""",
)
def points_near_in_time(spark, sf):
    t = inputs.trajectories(spark, sf).select("event_id", "traj_id", "time")
    return tr.window_counts(t, 120).select("event_id", "n_past", "n_future")


@query(
    "nearest_scene_in_time",
    f"""with {TRAJ}, sc as (select event_id scene_id, time st from t where prefix = 'signup'), sm as (select event_id, time from t where prefix <> 'signup'),
        b as (select sm.event_id, sm.time, sc.scene_id sb, sc.st tb from sm asof left join sc on sm.time >= sc.st),
        a as (select sm.event_id, sc.scene_id sa, sc.st ta from sm asof left join sc on sm.time <= sc.st),
        g as (select event_id, sb, sa, epoch_us(time) - epoch_us(tb) gb, epoch_us(ta) - epoch_us(time) ga from a join b using (event_id)),
        c as (select event_id, case when gb is not null and (ga is null or gb <= ga) then sb else sa end s, case when gb is not null and (ga is null or gb <= ga) then gb else ga end gap_us from g)
        select event_id, case when gap_us <= 30 * 60000000::bigint then s end nearest_scene, gap_us from c""",
)
def nearest_scene_in_time(spark, sf):
    t = inputs.trajectories(spark, sf)
    sc = t.filter("prefix = 'signup'").select("time", F.col("event_id").alias("scene_id"))
    out = tr.asof_scene(t.filter("prefix <> 'signup'").select("event_id", "time"), sc, 30)
    return out.select("event_id", "nearest_scene", "gap_us")


FRAMES = f"{TRAJ}, f as (select prefix, date_trunc('hour', time) as time, x, y, event_id from t), fc as (select prefix, time, count(x) n_points from f group by all)"


def _hourly(spark, sf):
    return inputs.trajectories(spark, sf).withColumn("time", F.date_trunc("hour", "time").cast("timestamp_ntz"))


@query("frames_with_previous", f"with {FRAMES} select prefix, time, n_points, lag(time) over (partition by prefix order by time) prev_time from fc")
def frames_with_previous(spark, sf):
    return tr.by_prefix(_hourly(spark, sf), tr.frames)


@query(
    "frames_after_first_full",
    f"""with {FRAMES}, s as (select *, max(case when n_points >= 4 then 1 end) over (partition by prefix order by time) ok from fc)
        select prefix, time, n_points from s where ok = 1""",
)
def frames_after_first_full(spark, sf):
    counts = _hourly(spark, sf).groupBy("prefix", "time").agg(F.count("x").alias("n_points"))
    return tr.trim_leading(counts, 4)


@query(
    "points_linked_between_frames",
    f"""with {FRAMES}, q as (select prefix, (epoch_us(time) // 3600000000)::bigint fr, event_id, x, y from f where x is not null),
        d as (select a.prefix, a.fr, a.event_id i, b.event_id n, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) d
              from q a join q b on a.prefix = b.prefix and b.fr = a.fr + 1 where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25),
        r as (select *, row_number() over (partition by i order by d, n) rf, row_number() over (partition by n order by d, i) rb from d)
        select prefix, fr frame, i point_id, n next_id, round(d, 6) displacement from r where rf = 1 and rb = 1""",
)
def points_linked_between_frames(spark, sf):
    h = _hourly(spark, sf)
    frame = F.floor(F.unix_micros(F.col("time").cast("timestamp")) / 3_600_000_000)
    p = h.select("prefix", frame.alias("frame"), F.col("event_id").alias("point_id"), "x", "y")
    return tr.link_points(p, 25.0).select("prefix", "frame", "point_id", "next_id", _r("displacement"))


@query(
    "trajectories_united",
    f"""with {TRAJ} select event_id, prefix || '__' || strftime(time, '%Y%m%d_%H%M') scene_id, date_trunc('minute', time) as time, prefix, case when prefix <> 'view' then x end x from t""",
)
def trajectories_united(spark, sf):
    t = inputs.trajectories(spark, sf)
    scene = F.concat("prefix", F.lit("__"), F.date_format("time", "yyyyMMdd_HHmm"))
    rows = t.select("event_id", scene.alias("scene_id"), "x")
    view = F.col("scene_id").startswith("view__")
    return tr.union_trajectories(
        rows.filter(~view), rows.filter(view).drop("x"), pattern=r"^(.*?)__(\d{8}_\d{4})$", time_format="yyyyMMdd_HHmm"
    ).select("event_id", "scene_id", "time", "prefix", "x")
