"""Window tiling of scenes, coordinates, maps and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequery.functions import names
from tilequery.operators import geo, rasters, stats, tiling
from tilequery.operators.select import tiles_in_order as tiles_sorted
from tilequery.plans import inputs
from tilequery.plans.inputs import EMB, GRID, TRAJ
from tilequery.plans.registry import query
from tilequery.plans.triplet_queries import _r
from tilequery.session import inline_if_small

SCENES = "s as (select c_custkey::varchar scene_id, c_name || '.png' filepath, 600 nx, 400 ny from customer)"
WINDOWS = f"{SCENES}, w as (select s.*, (q % 7 * 50)::int i, (q // 7 * 50)::int j, q::int spatial from s, range(21) r(q))"


@query("moving_windows", f"with {WINDOWS} select scene_id, i, j, spatial from w")
def moving_windows(spark, sf):
    return tiling.moving_windows(inputs.scenes(spark, sf)).select("scene_id", "i", "j", "spatial")


@query(
    "window_numbers",
    f"""with {WINDOWS}, p as (select scene_id, row_number() over (order by filepath) - 1 pos from s)
        select (pos * 21 + spatial)::bigint tile_id, scene_id, filepath scene_filepath, i, j from w join p using (scene_id)""",
)
def window_numbers(spark, sf):
    return tiling.number_tiles(inputs.scenes(spark, sf))


@query(
    "window_index_maths",
    """select l_orderkey tile_id, l_linenumber, (l_orderkey // 21)::bigint scene_pos, (l_orderkey % 21)::int spatial,
       (l_orderkey % 21 % 7 * 50)::int i, (l_orderkey % 21 // 7 * 50)::int j from lineitem""",
)
def window_index_maths(spark, sf):
    rows = inputs.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tile_id"), "l_linenumber")
    return tiling.window_ij(tiling.split_tile_id(rows, 21), 7)


@query("window_centres", f"with {WINDOWS} select scene_id, i + 128 i0, j + 128 j0, 256 tile_nx, 256 tile_ny from w")
def window_centres(spark, sf):
    w = tiling.with_centres(tiling.moving_windows(inputs.scenes(spark, sf)))
    return w.select("scene_id", "i0", "j0", "tile_nx", "tile_ny")


@query(
    "windows_around_points",
    f"""with {TRAJ}, p as (select event_id, x::int i, y::int j from t),
        v as (select *, coalesce(i between 16 and 184 and j between 16 and 84, false) ok from p)
        select event_id, ok as valid, case when ok then i - 16 end i_start, case when ok then j - 16 end j_start from v""",
)
def windows_around_points(spark, sf):
    p = inputs.trajectories(spark, sf).select(
        "event_id", F.rint("x").cast("int").alias("i"), F.rint("y").cast("int").alias("j"), F.lit(200).alias("nx"), F.lit(100).alias("ny")
    )
    return tiling.centred_windows(p, (32, 32)).select("event_id", "valid", "i_start", "j_start")


#: pixel rows of a label scene whose tiles need no more
SCENE_ROWS = 3200


def _coordinates(spark, sf):
    """Coordinate lists per label scene: every pixel of 600 x 3200, x and y in metres.

    A scene with more tiles than that holds has as many rows as its last tile needs. Rows are counted from the far end, where y is
    always 3199 * 500 m, so a taller scene begins below zero.
    """
    g = inputs.gridded(spark, sf).groupBy("scene_id").agg(F.greatest(F.max("j0") + 1, F.lit(SCENE_ROWS)).alias("_ny"))
    s = inline_if_small(g)
    xs = s.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(599))).alias("i")).withColumn("x", F.col("i") * 1000.0 + F.col("scene_id"))
    # strips of rows, so that no list is longer than one of them
    strips = s.select("scene_id", "_ny", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1, F.lit(SCENE_ROWS))).alias("_s"))
    rows = F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + SCENE_ROWS, F.col("_ny")) - 1))
    ys = strips.select("scene_id", "_ny", rows.alias("j")).withColumn("y", (F.col("j") - F.col("_ny") + SCENE_ROWS) * 500.0).drop("_ny")
    return xs, ys


@query(
    "tile_coordinates",
    f"""with {GRID} select scene_id, tile_id, i0 * 1000.0::double + scene_id x, (3199 - j0) * 500.0::double y, 256000.0::double lx_tile, 128000.0::double ly_tile from g""",
)
def tile_coordinates(spark, sf):
    xs, ys = _coordinates(spark, sf)
    out = tiling.attach_coords(inputs.gridded(spark, sf), xs, ys)
    return out.select("scene_id", "tile_id", "x", "y", "lx_tile", "ly_tile")


@query(
    "tiles_in_order",
    f"""with {GRID}, q as (select scene_id, tile_id, i0 * 1000.0::double + scene_id x, (3199 - j0) * 500.0::double y from g)
        select scene_id, tile_id, x, y, (row_number() over (order by scene_id, x, y, tile_id) - 1)::bigint place from q""",
)
def tiles_in_order(spark, sf):
    xs, ys = _coordinates(spark, sf)
    out = tiling.attach_coords(inputs.gridded(spark, sf), xs, ys)
    return tiles_sorted(out.select("scene_id", "tile_id", "x", "y"))


@query(
    "tile_centre_grid",
    f"with {GRID} select scene_id, x.i0 * 1000.0::double x, y.j0 * 500.0::double y from (select distinct scene_id, i0 from g) x join (select distinct scene_id, j0 from g) y using (scene_id)",
)
def tile_centre_grid(spark, sf):
    g = inputs.with_xy(inputs.gridded(spark, sf))
    return tiling.tile_centres(g.select("scene_id", "x").distinct(), g.select("scene_id", "y").distinct())


@query("one_scene_shape", f"with {SCENES} select distinct nx, ny from s")
def one_scene_shape(spark, sf):
    shape = stats.assert_uniform(inputs.scenes(spark, sf), "nx", "ny")
    return spark.createDataFrame([shape], "nx int, ny int")


# --- maps ---------------------------------------------------------------------


@query("component_limits", f"with {GRID} select scene_id, round(min(embedding[1]), 6) lo_c0, round(max(embedding[1]), 6) hi_c0 from g group by scene_id")
def component_limits(spark, sf):
    from tilequery.operators.select import component

    lim = stats.min_max(component(inputs.gridded(spark, sf), 0), ["c0"], ["scene_id"])
    return lim.select("scene_id", _r("lo_c0"), _r("hi_c0"))


@query(
    "rgb_map",
    f"""with {GRID}, l as (select {", ".join(f"min(embedding[{k}]) lo{k}, max(embedding[{k}]) hi{k}" for k in (1, 2, 3))} from g)
        select scene_id, tile_id, {", ".join(f"round((embedding[{k}] - lo{k}) / (hi{k} - lo{k}), 6) {n}" for k, n in ((1, "r"), (2, "g"), (3, "b")))},
        0.5::double a from g, l""",
)
def rgb_map(spark, sf):
    out = rasters.make_rgb(inputs.gridded(spark, sf).select("scene_id", "tile_id", "embedding"), [0, 1, 2])
    return out.select("scene_id", "tile_id", _r("r"), _r("g"), _r("b"), "a")


_COLOURS = ", ".join(f"({n}, {r}::double, {g}::double, {b}::double)" for n, (r, g, b) in enumerate(rasters.PALETTE))


@query(
    "label_map",
    f"""with {EMB}, c(pos, r, g, b) as (values {_COLOURS}), d as (select tile_id, label, (dense_rank() over (order by label) - 1)::int palette_pos from emb)
        select tile_id, label, palette_pos, r, g, b, 0.3::double a from d join c on palette_pos % 10 = pos""",
)
def label_map(spark, sf):
    return rasters.label_colours(inputs.embeddings(spark, sf).select("tile_id", "label"))


@query(
    "map_extent",
    f"""with {GRID} select scene_id, (min(i0) - 25)::double i0_min, (max(i0) + 25)::double i0_max, (min(j0) - 25)::double j0_min, (max(j0) + 25)::double j0_max,
        (min(i0) - 25) * 1000.0::double x_min, (max(i0) + 25) * 1000.0::double x_max, (min(j0) - 25) * 500.0::double y_min, (max(j0) + 25) * 500.0::double y_max from g group by scene_id""",
)
def map_extent(spark, sf):
    return rasters.image_extent(inputs.with_xy(inputs.gridded(spark, sf)))


@query(
    "component_maps",
    f"""with {GRID} select scene_id, tile_id, c::int component, round(embedding[c + 1], 6) as value from g, (values (0), (5), (9)) c(c)""",
)
def component_maps(spark, sf):
    m = rasters.component_map(inputs.gridded(spark, sf).select("scene_id", "tile_id", "embedding"), [0, 5, 9])
    return m.select("scene_id", "tile_id", "component", _r("value"))


@query(
    "tile_footprints",
    f"with {GRID} select tile_id, i0 * 1000.0::double - 128000 x_min, i0 * 1000.0::double + 128000 x_max, j0 * 500.0::double - 64000 y_min, j0 * 500.0::double + 64000 y_max from g",
)
def tile_footprints(spark, sf):
    g = inputs.with_xy(inputs.gridded(spark, sf))
    return rasters.footprints(g, 256e3, 128e3).select("tile_id", "x_min", "x_max", "y_min", "y_max")


@query(
    "distance_to_region",
    f"""with {GRID}, m as (select d, avg(v) c from (select unnest(range(64)) d, unnest(embedding) v from g where i0 * 1000.0 >= 300000) group by d),
        c as (select list(c order by d) c from m) select tile_id, round(list_distance(embedding, c), 6) dist from g, c""",
)
def distance_to_region(spark, sf):
    m = rasters.distance_map(inputs.with_xy(inputs.gridded(spark, sf)), x=(300e3, None))
    return m.select("tile_id", _r("dist"))


@query(
    "scatter_of_components",
    f"""with {GRID} select scene_id, i0, j0, {", ".join(f"embedding[{k + 1}] {n}" for k, n in enumerate(("px", "py", "pz", "colour")))}, printf('%05d_%05d.png', i0, j0) image from g""",
)
def scatter_of_components(spark, sf):
    return rasters.scatter_table(inputs.gridded(spark, sf))


@query(
    "map_resolution",
    f"""with {GRID}, r as (select distinct scene_id, (scene_id + 1)::double tile_resolution_km, ((scene_id + 1) * 50)::double step_km from g)
        select *, scene_id || chr(10) || '(lat0, lon0)=(12.5, -52.0)' || chr(10) || printf('m NN model, 256 x 256 tiles at %.2fkm resolution, 50 step (%.2fkm)',
               tile_resolution_km, step_km) || chr(10) || 'prediction RGB from pca components [0, 1, 2]' title from r""",
)
def map_resolution(spark, sf):
    g = inputs.gridded(spark, sf).select(
        "scene_id",
        *[F.lit(256).alias(f"tile_n{a}") for a in "xy"],
        *[(F.lit(256e3) * (F.col("scene_id") + 1)).alias(f"l{a}_tile") for a in "xy"],
    )
    info = rasters.map_info(g, 50)
    title = names.map_title(
        F.col("scene_id").cast("string"), F.lit(12.5), F.lit(-52.0), F.lit("m"), F.lit(256), F.lit(256),
        F.col("tile_resolution_km"), F.lit(50), "pca", [0, 1, 2],
    )
    return info.withColumn("title", title)


# --- domains ------------------------------------------------------------------

#: places out of events: latitude from the value, longitude from the property
PLACES = f"{TRAJ}, places as (select event_id, x / 10 + 35 lat, y * 0.6 + 275 lon from t where x is not null)"


def _places(spark, sf):
    t = inputs.trajectories(spark, sf).filter("x is not null")
    return t.select("event_id", (F.col("x") / 10 + 35).alias("lat"), (F.col("y") * 0.6 + 275).alias("lon"))


#: corners (lat, lon) of a sample domain
DOMAIN = ((56.0, 282.4), (42.1, 280.3), (41.6, 331.2), (56.7, 332.3))


@query("places_in_extent", f"with {PLACES} select event_id from places where lon - 360 between -70 and -40 and lat between 36 and 40")
def places_in_extent(spark, sf):
    return geo.in_extent(_places(spark, sf), (-70, -40), (36, 40)).select("event_id")


#: the same places turned so that they lie on both sides of the date line, and all around the globe
_DATE_LINE = f"{PLACES}, turned as (select event_id, lat, lon - 115 lon from places)"


def _turned(spark, sf):
    return _places(spark, sf).withColumn("lon", F.col("lon") - 115)


@query(
    "places_in_extent_over_date_line",
    f"with {_DATE_LINE} select event_id from turned where (lon between 170 and 190 or lon - 360 between 170 and 190) and lat between 36 and 50",
)
def places_in_extent_over_date_line(spark, sf):
    return geo.in_extent(_turned(spark, sf), (170, -170), (36, 50)).select("event_id")


@query("places_everywhere", f"with {PLACES} select event_id, 'c' || k as circle from places, range(3) r(k) where lat between 36 and 50")
def places_everywhere(spark, sf):
    p = _places(spark, sf)
    circles = ((-180, 180), (0, 360), (100, 460))
    parts = [geo.in_extent(p, c, (36, 50)).select("event_id", F.lit(f"c{k}").alias("circle")) for k, c in enumerate(circles)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EDGES = ", ".join(
    f"({a[0]}::double, {a[1] - 360}::double, {b[0]}::double, {b[1] - 360}::double)" for a, b in zip(DOMAIN, DOMAIN[1:] + DOMAIN[:1])
)


@query(
    "places_in_domain",
    f"""with {PLACES}, e(a0, o0, a1, o1) as (values {_EDGES}),
        h as (select event_id, count(*) filter ((a0 > lat) <> (a1 > lat) and lon - 360 < (o1 - o0) * (lat - a0) / (a1 - a0) + o0) n from places, e group by event_id)
        select event_id from h where n % 2 = 1""",
)
def places_in_domain(spark, sf):
    domain = spark.createDataFrame([(n, *p) for n, p in enumerate(DOMAIN)], "pos int, lat double, lon double")
    return geo.in_domain(_places(spark, sf), domain).select("event_id")


TILES = "tl as (select c_custkey tile_id, 36.0 + (c_custkey % 40) * 0.25 lat, 276.0 + (c_custkey % 97) * 0.5 lon, 20000.0 size from customer)"


def _geo_tiles(spark, sf):
    c = F.col("c_custkey")
    return inputs.table(spark, sf, "customer").select(
        c.alias("tile_id"), (F.lit(36.0) + (c % 40) * 0.25).alias("lat"), (F.lit(276.0) + (c % 97) * 0.5).alias("lon"), F.lit(20000.0).alias("size")
    )


_HALF = f"degrees(size / {2 * geo.EARTH_RADIUS})"


@query(
    "tile_outlines",
    f"""with {TILES} select tile_id, round(lat - {_HALF}, 6)::double south, round(lat + {_HALF}, 6)::double north,
        round(lon - {_HALF} / cos(radians(lat)), 6)::double west, round(lon + {_HALF} / cos(radians(lat)), 6)::double east from tl""",
)
def tile_outlines(spark, sf):
    o = geo.outline(_geo_tiles(spark, sf))
    at = lambda k, c: F.col("outline")[k][c]
    return o.select("tile_id", _r(at(0, "lat"), "south"), _r(at(2, "lat"), "north"), _r(at(0, "lon"), "west"), _r(at(2, "lon"), "east"))


@query(
    "field_within_tiles",
    f"""with {PLACES}, {TILES} select tile_id, event_id from places p join tl on abs(p.lat - tl.lat) <= {_HALF} and abs(p.lon - tl.lon) <= {_HALF} / cos(radians(tl.lat))""",
)
def field_within_tiles(spark, sf):
    return geo.crop_field(_places(spark, sf), _geo_tiles(spark, sf)).select("tile_id", "event_id")


@query(
    "field_within_tiles_over_date_line",
    f"""with {_DATE_LINE}, {TILES}, t2 as (select tile_id, lat, lon - 115 lon, size from tl)
        select tile_id, event_id from turned p join t2 on abs(p.lat - t2.lat) <= {_HALF} and abs(p.lon - t2.lon) <= {_HALF} / cos(radians(t2.lat))""",
)
def field_within_tiles_over_date_line(spark, sf):
    tiles = _geo_tiles(spark, sf).withColumn("lon", F.col("lon") - 115)
    return geo.crop_field(_turned(spark, sf), tiles).select("tile_id", "event_id")
