"""Selection, ordering, sampling and grid views of embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequery.functions import names
from tilequery.operators import manifold, sampling
from tilequery.operators import select as sel
from tilequery.operators import stats
from tilequery.plans import inputs
from tilequery.plans.inputs import EMB, FLAT, GRID, WIDE
from tilequery.plans.registry import query
from tilequery.plans.triplet_queries import _r


@query(
    "rank_to_tile",
    f"""with {EMB} select a.tile_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) dist
        from emb a, (select embedding from emb where tile_id = 17) b order by 2, 1 limit 50""",
)
def rank_to_tile(spark, sf):
    return sel.rank_to_tile(inputs.embeddings(spark, sf), 17, 50).select("tile_id", _r("dist"))


@query("embedding_components", f"with {EMB} select tile_id, label, embedding[1]::double c0, embedding[8]::double c7 from emb")
def embedding_components(spark, sf):
    return sel.component(inputs.embeddings(spark, sf), 0, 7)


@query(
    "component_means",
    f"""with {EMB} select emb_dim, round(avg(value), 6) mean, count(*) n from
        (select unnest(range(len(embedding)))::int emb_dim, unnest(embedding)::double as value from emb) group by emb_dim""",
)
def component_means(spark, sf):
    rows = sel.explode_dims(inputs.embeddings(spark, sf))
    return rows.groupBy("emb_dim").agg(_r(F.avg(F.col("value").cast("double")), "mean"), F.count("*").alias("n"))


@query("long_and_back", f"with {EMB} select tile_id, label, round(list_sum(list_transform(embedding::double[], lambda v, i: v * i)), 6) s from emb")
def long_and_back(spark, sf):
    back = sel.collect_dims(sel.explode_dims(inputs.embeddings(spark, sf)), ["tile_id", "label"])
    s = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return back.select("tile_id", "label", _r(s, "s"))


@query("first_tiles", f"with {EMB} select tile_id, label from emb order by tile_id limit 10")
def first_tiles(spark, sf):
    return sel.first_tiles(inputs.embeddings(spark, sf), 10).select("tile_id", "label")


@query(
    "tiles_by_list",
    f"""with {EMB}, l as (select * from (values (0, 40), (1, 7), (2, 40), (3, 3)) l(pos, tile_id))
        select l.pos::int pos, tile_id::bigint tile_id, printf('%d (%d)', tile_id, label) as label from l join emb using (tile_id)""",
)
def tiles_by_list(spark, sf):
    e = inputs.embeddings(spark, sf)
    return sel.pick(e, [40, 7, 40, 3], sel.template_label("{} ({})", "tile_id", "label")).select("pos", "tile_id", "label")


@query("tile_numbers", "select label, vec_id tile_id, row_number() over (order by label, vec_id) - 1 as row from embeddings")
def tile_numbers(spark, sf):
    return sel.numbered(inputs.embeddings(spark, sf).select("label", "tile_id"), "label", "tile_id")


@query("exact_split_sizes", "select 'train' part, floor(count(*) * 0.9)::bigint n from embeddings union all select 'valid', count(*) - floor(count(*) * 0.9)::bigint from embeddings")
def exact_split_sizes(spark, sf):
    train, valid = sel.split_exact(inputs.embeddings(spark, sf).select("tile_id"), 0.9, seed=3)
    both = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return both.groupBy("part").agg(F.countDistinct("tile_id").alias("n"))


@query("random_points_drawn", "select count(*)::bigint n, true known from range(100)")
def random_points_drawn(spark, sf):
    e = inputs.embeddings(spark, sf).select("tile_id")
    drawn = sel.random_points(e, 100, seed=5).join(e.withColumn("known", F.lit(True)), "tile_id", "left")
    return drawn.agg(F.count("*").alias("n"), F.every(F.coalesce("known", F.lit(False))).alias("known"))


@query("tiles_with_hue", f"with {EMB} select tile_id, label hue, (dense_rank() over (order by label) - 1)::int palette_pos from emb")
def tiles_with_hue(spark, sf):
    e = inputs.embeddings(spark, sf)
    hue = e.select("tile_id", F.col("label").alias("hue"))
    return sel.with_hue(e.select("tile_id"), hue).select("tile_id", "hue", "palette_pos")


# --- scenes as tables ---------------------------------------------------------


@query("scenes_by_prefix", "select c_custkey::varchar scene_id from customer where regexp_matches(c_custkey::varchar, '^1.*')")
def scenes_by_prefix(spark, sf):
    return sel.filter_scenes(inputs.scenes(spark, sf), "1.*").select("scene_id")


@query("tiles_in_x_range", f"with {GRID} select scene_id, tile_id from g where i0 * 1000.0 >= 250000")
def tiles_in_x_range(spark, sf):
    return sel.slice_xy(inputs.with_xy(inputs.gridded(spark, sf)), x=(250e3, None)).select("scene_id", "tile_id")


@query("tiles_of_one_scene", f"with {GRID} select i0, j0, tile_id from g where scene_id = 4")
def tiles_of_one_scene(spark, sf):
    return sel.one_scene(inputs.gridded(spark, sf), 4).select("i0", "j0", "tile_id")


@query(
    "tiles_in_km",
    f"""with {GRID}, u as (select *, case when scene_id < 5 then 'm' else 'km' end u from g)
        select tile_id, round(case when u = 'm' then i0 * 1000.0 / 1000 else i0 * 1000.0 end, 6)::double x,
               round(case when u = 'm' then j0 * 500.0 / 1000 else j0 * 500.0 end, 6)::double y, 'km' units from u""",
)
def tiles_in_km(spark, sf):
    g = inputs.with_xy(inputs.gridded(spark, sf)).withColumn("units", F.when(F.col("scene_id") < 5, "m").otherwise("km"))
    return sel.to_km(g).select("tile_id", _r("x"), _r("y"), "units")


@query(
    "scene_as_grid",
    f"""with {GRID} select j0, {", ".join(f"max(tile_id) filter (i0 = {128 + 50 * k} and scene_id = 3) as c{k}" for k in range(8))}
        from g where scene_id = 3 group by j0""",
)
def scene_as_grid(spark, sf):
    xs = [128 + 50 * k for k in range(8)]
    grid = sel.to_grid(sel.one_scene(inputs.gridded(spark, sf), 3), "i0", "j0", "tile_id", xs)
    return sel.rename(grid, {str(x): f"c{k}" for k, x in enumerate(xs)})


@query("scenes_united", f"with {GRID} select scene_id, tile_id, case when scene_id < 5 then 'old' end image_path, 50 step from g")
def scenes_united(spark, sf):
    g = inputs.gridded(spark, sf).select("scene_id", "tile_id")
    old = sel.with_attrs(g.filter("scene_id < 5"), image_path="old")
    return sel.with_attrs(sel.union_scenes(old, g.filter("scene_id >= 5")), step=50)


@query("scenes_pending", "select c_custkey::varchar scene_id from customer where c_custkey not in (select o_custkey from orders)")
def scenes_pending(spark, sf):
    done = inputs.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("scene_id"))
    return sel.pending(inputs.scenes(spark, sf), done).select("scene_id")


@query(
    "coordinate_spacing",
    f"with {GRID} select i0, (i0 - lag(i0) over (order by i0))::int step from (select distinct i0 from g)",
)
def coordinate_spacing(spark, sf):
    return stats.spacing(inputs.gridded(spark, sf), "i0")


# --- clusters -----------------------------------------------------------------


def _clustered(spark, sf):
    return inputs.embeddings(spark, sf).withColumnRenamed("label", "cluster_id")


CENTRE = f"""{EMB}, m as (select label, emb_dim, avg(v) c from (select label, unnest(range(len(embedding))) emb_dim, unnest(embedding)::double v from emb)
             group by all), mm as (select label, list(c order by emb_dim) c from m group by label)"""


@query("cluster_centroids", f"with {CENTRE} select label cluster_id, round(list_sum(c), 6) total, round(list_distance(c, list_transform(c, lambda x: 0.0::double)), 6) length, (select count(*) from emb where emb.label = mm.label) n_tiles from mm")
def cluster_centroids(spark, sf):
    c = sampling.centroids(_clustered(spark, sf))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v)
    from tilequery.functions.vectors import norm

    return c.select("cluster_id", _r(total, "total"), _r(norm("centroid"), "length"), "n_tiles")


def _ranked_sql(order: str, value: str, source: str, k: int = 10) -> str:
    return f"""select label cluster_id, tile_id, r::int as rank, round({value}, 6) {value} from
        (select *, row_number() over (partition by label order by {order}) r from {source}) where r <= {k}"""


@query(
    "cluster_samples_central",
    f"""with {CENTRE}, d as (select tile_id, label, list_sum(list_transform(list_zip(c, embedding), lambda z: abs(z[1] - z[2]::double))) dist_to_center
        from emb join mm using (label)) {_ranked_sql("dist_to_center, tile_id", "dist_to_center", "d")}""",
)
def cluster_samples_central(spark, sf):
    out = sampling.sample_clusters(_clustered(spark, sf), 10, "center_dist")
    return out.select("cluster_id", "tile_id", "rank", _r("dist_to_center"))


def _triplet_samples(spark, sf, method):
    w = inputs.wide(spark, sf).withColumnRenamed("label", "cluster_id")
    return sampling.sample_clusters(w, 10, method).select("cluster_id", "tile_id", "rank", _r("near_dist"))


NEAR = f"{WIDE}, nd as (select tile_id, label, list_sum(list_transform(list_zip(anchor, neighbor), lambda z: abs(z[1] - z[2]))) near_dist from wide)"


@query("cluster_samples_best", f"with {NEAR} {_ranked_sql('near_dist, tile_id', 'near_dist', 'nd')}")
def cluster_samples_best(spark, sf):
    return _triplet_samples(spark, sf, "best_triplets")


@query("cluster_samples_worst", f"with {NEAR} {_ranked_sql('near_dist desc, tile_id desc', 'near_dist', 'nd')}")
def cluster_samples_worst(spark, sf):
    return _triplet_samples(spark, sf, "worst_triplets")


@query("cluster_samples_random", f"with {EMB} select label cluster_id, least(count(*), 10)::bigint n from emb group by label")
def cluster_samples_random(spark, sf):
    return sampling.sample_clusters(_clustered(spark, sf), 10, "random", seed=1).groupBy("cluster_id").agg(F.countDistinct("tile_id").alias("n"))


@query("cluster_sizes", f"with {EMB} select label cluster_id, count(*) n_tiles, count(*) || chr(10) || chr(65 + label) as label from emb group by emb.label")
def cluster_sizes(spark, sf):
    return stats.cluster_sizes(_clustered(spark, sf), letters=True)


# --- the plane ----------------------------------------------------------------


@query(
    "nearest_tile_to_points",
    f"""with {FLAT}, s as (select (max(x) - min(x)) / (max(y) - min(y)) s from flat),
        p as (select label point_id, avg(x) px, avg(y) py from flat group by label),
        d as (select point_id, tile_id, sqrt((px - x) ** 2 + ((py - y) * s) ** 2) dist from p, flat, s)
        select point_id::bigint point_id, arg_min(tile_id, dist) tile_id, round(min(dist), 6) dist from d group by point_id""",
)
def nearest_tile_to_points(spark, sf):
    f = inputs.flat(spark, sf)
    pts = f.groupBy(F.col("label").cast("long").alias("point_id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = sampling.nearest_tile(f, pts, sampling.axis_scaling(f))
    return near.select("point_id", "tile_id", _r("dist"))


@query(
    "points_to_annotate",
    f"""with {FLAT}, s as (select (max(x) - min(x)) / (max(y) - min(y)) s from flat),
        p as (select * from (values (0, 0.0, 0.0), (1, 0.1, -0.1)) p(point_id, px, py)),
        d as (select point_id, tile_id, sqrt((px - x) ** 2 + ((py - y) * s) ** 2) dist from p, flat, s)
        select point_id::bigint point_id, arg_min(tile_id, dist) tile_id, round(min(dist), 6) dist from d group by point_id""",
)
def points_to_annotate(spark, sf):
    out = sampling.annotate_points(inputs.flat(spark, sf), ([0.0, 0.1], [0.0, -0.1]))
    return out.select("point_id", "tile_id", _r("dist"))


@query(
    "grid_node_sample",
    f"""with {FLAT}, q as (select *, round_even((x + 0.4) / 0.05, 0)::int ix, round_even((y + 0.4) / 0.05, 0)::int iy from flat where an_dist < 1.4),
        d as (select *, sqrt((x - (-0.4 + ix * 0.05)) ** 2 + (y - (-0.4 + iy * 0.05)) ** 2) node_dist from q
              where ix between 0 and 15 and iy between 0 and 15)
        select ix, iy, arg_min(tile_id, node_dist) tile_id, round(min(node_dist), 6) node_dist from d where node_dist < 0.025 group by ix, iy""",
)
def grid_node_sample(spark, sf):
    out = sampling.sample_grid(inputs.flat(spark, sf), 0.05, 1.4, (-0.4, 0.4), (-0.4, 0.4))
    return out.select("ix", "iy", "tile_id", _r("node_dist"))


BINS = """b as (select *, trunc((x + 0.4) / 0.1)::int ix, trunc((y + 0.4) / 0.1)::int iy from flat)"""


@query(
    "manifold_bins",
    f"""with {FLAT}, {BINS} select ix, iy, count(*) n_tiles, arg_min(tile_id, an_dist) tile_id, round(min(an_dist), 6) an_dist
        from b where ix between 0 and 7 and iy between 0 and 7 group by ix, iy having count(*) >= 4""",
)
def manifold_bins(spark, sf):
    out = manifold.bin_manifold(inputs.flat(spark, sf), 0.8, 8, 4)
    return out.select("ix", "iy", "n_tiles", "tile_id", _r("an_dist"))


@query(
    "manifold_extent",
    f"""with {FLAT}, l as (select 2 * greatest(abs(min(x)), abs(max(x)), abs(min(y)), abs(max(y))) l from flat)
        select trunc(l / 0.05)::int n, round(trunc(l / 0.05) * 0.05, 6) lxy from l""",
)
def manifold_extent(spark, sf):
    side, n = manifold.manifold_extent(inputs.flat(spark, sf), 0.05)
    return spark.createDataFrame([(n, side)], "n int, lxy double").select("n", _r("lxy"))


@query(
    "manifold_grid_view",
    f"""with {FLAT}, l as (select trunc(2 * greatest(abs(min(x)), abs(max(x)), abs(min(y)), abs(max(y))) / 0.05) n from flat),
        b as (select tile_id, an_dist, n, trunc((x + (n * 0.05 + 0.1) / 2) / ((n * 0.05 + 0.1) / n))::int ix,
                     trunc((y + (n * 0.05 + 0.1) / 2) / ((n * 0.05 + 0.1) / n))::int iy from flat, l)
        select ix, iy, count(*) n_tiles, arg_min(tile_id, an_dist) tile_id from b
        where ix between 0 and n - 1 and iy between 0 and n - 1 group by ix, iy""",
)
def manifold_grid_view(spark, sf):
    f = inputs.flat(spark, sf).select("tile_id", "x", "y")
    return manifold.manifold_view(inputs.wide(spark, sf), f, "grid", 0.05).select("ix", "iy", "n_tiles", "tile_id")


@query(
    "manifold_scatter_view",
    f"""with {FLAT}, s as (select an_dist v, count(*) n from flat group by 1),
        c as (select v, sum(n) over (order by v) / (select count(*) from flat) f from s),
        t as (select max(v) filter (f <= 0.3) + (0.3 - max(f) filter (f <= 0.3)) / nullif(min(f) filter (f >= 0.3) - max(f) filter (f <= 0.3), 0)
                     * (min(v) filter (f >= 0.3) - max(v) filter (f <= 0.3)) x, max(v) filter (f <= 0.3) y from c),
        q as (select flat.*, round_even((flat.x + 1.5) / 0.05, 0)::int ix, round_even((flat.y + 1.5) / 0.05, 0)::int iy from flat, t
              where an_dist < coalesce(t.x, t.y)),
        d as (select *, sqrt((x - (-1.5 + ix * 0.05)) ** 2 + (y - (-1.5 + iy * 0.05)) ** 2) node_dist from q
              where ix between 0 and 59 and iy between 0 and 59)
        select ix, iy, arg_min(tile_id, node_dist) tile_id from d where node_dist < 0.025 group by ix, iy""",
)
def manifold_scatter_view(spark, sf):
    f = inputs.flat(spark, sf).select("tile_id", "x", "y")
    return manifold.manifold_view(inputs.wide(spark, sf), f, "scatter", 0.05).select("ix", "iy", "tile_id")


# --- names --------------------------------------------------------------------


@query(
    "scene_names",
    """with s as (select c_custkey k, replace(lower(c_name), '#', '_') || '__' || strftime(timestamp '2020-01-01' + interval 1 minute * c_custkey::int, '%Y%m%d_%H%M') scene_id from customer)
       select scene_id, regexp_extract(scene_id, '^(.*?)__', 1) prefix, timestamp '2020-01-01' + interval 1 minute * k::int as time,
              timestamp '2020-01-01' + interval 1 minute * k::int + interval 120 minute as until,
              md5('model' || scene_id) key, upper(chr(97 + (k % 26)::int)) letter, scene_id || '.embeddings.50_step' stored from s""",
)
def scene_names(spark, sf):
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_name")
    stamp = F.date_format(start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("c_custkey").cast("int")), "yyyyMMdd_HHmm")
    s = c.withColumn("scene_id", F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("_")), F.lit("__"), stamp))
    prefix, time = names.parse_scene_id(F.col("scene_id"), r"^(.*?)__(\d{8}_\d{4})$")
    return s.select(
        "scene_id",
        prefix.alias("prefix"),
        time.alias("time"),
        (time + names.minutes(120)).alias("until"),
        names.dataset_key("model", F.col("scene_id")).alias("key"),
        names.letter((F.col("c_custkey") % 26).cast("int")).alias("letter"),
        names.change_suffix(F.concat("scene_id", F.lit(".png")), ".png", ".embeddings.50_step").alias("stored"),
    )


@query(
    "option_strings",
    """select p_partkey, p_size::double as n_components, round(p_retailprice, 2)::double as alpha, 'pca_transform__n_components_' || p_size as name from part""",
)
def option_strings(spark, sf):
    p = inputs.table(spark, sf, "part")
    text = F.concat(F.lit("n_components="), F.col("p_size"), F.lit(",alpha="), F.round("p_retailprice", 2).cast("string"))
    opts = names.kwargs_map(text)
    return p.select(
        "p_partkey",
        opts["n_components"].alias("n_components"),
        F.round(opts["alpha"], 2).alias("alpha"),
        F.concat(F.lit(names.transform_name("pca", n_components="")), F.col("p_size").cast("string")).alias("name"),
    )


@query(
    "scalar_functions",
    """select l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) root, round_even(l_quantity / 4, 0)::double even, trunc(l_extendedprice / 100)::int cell,
       ceil(l_quantity / 8)::bigint n_rows, round(abs(l_discount - 0.05), 6) off from lineitem""",
)
def scalar_functions(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", _r(F.sqrt("l_quantity"), "root"), F.rint(F.col("l_quantity") / 4).alias("even"),
        (F.col("l_extendedprice") / 100).cast("int").alias("cell"), F.ceil(F.col("l_quantity") / 8).alias("n_rows"),
        _r(F.abs(F.col("l_discount") - 0.05), "off"),
    )
