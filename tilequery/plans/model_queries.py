"""Neighbours, transforms, clustering, projections, training and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequery.operators import density, knn, linkage, training, transforms
from tilequery.operators.select import numbered
from tilequery.plans import inputs
from tilequery.plans.image_queries import CROP_MEANS, channel_means
from tilequery.plans.inputs import EMB
from tilequery.plans.registry import query
from tilequery.plans.triplet_queries import _r
from tilequery.session import scratch_path


@query(
    "nearest_neighbours",
    f"""with {EMB}, e as (select tile_id, embedding::double[] v from emb),
        d as (select a.tile_id, b.tile_id neighbor_id, list_distance(a.v, b.v) dist from e a join e b on a.tile_id <> b.tile_id),
        r as (select *, row_number() over (partition by tile_id order by dist, neighbor_id) r from d)
        select tile_id, r::int as rank, neighbor_id, round(dist, 6) dist from r where r <= 5""",
)
def nearest_neighbours(spark, sf):
    e = inputs.embeddings(spark, sf)
    return knn.knn_join(e, e, 5).select("tile_id", "rank", "neighbor_id", _r("dist"))


@query(
    "nearest_of_other_half",
    f"""with {EMB}, e as (select tile_id, embedding::double[] v from emb),
        d as (select a.tile_id, b.tile_id neighbor_id, list_distance(a.v, b.v) dist from e a join e b on a.tile_id % 2 = 0 and b.tile_id % 2 = 1),
        r as (select *, row_number() over (partition by tile_id order by dist, neighbor_id) r from d)
        select tile_id, r::int as rank, neighbor_id, round(dist, 6) dist from r where r <= 3""",
)
def nearest_of_other_half(spark, sf):
    """The k-nearest join of two different tables: even against odd tiles, together all of them."""
    e = inputs.embeddings(spark, sf)
    out = knn.knn_join(e.filter("tile_id % 2 = 0"), e.filter("tile_id % 2 = 1"), 3)
    return out.select("tile_id", "rank", "neighbor_id", _r("dist"))


@query("hashed_neighbour_recall", "select count(*)::bigint n, (5 * count(*))::bigint found, true enough from embeddings")
def hashed_neighbour_recall(spark, sf):
    """How many of the five nearest tiles the hashed buckets find, counted against the exact join: at least nine of ten."""
    e = inputs.embeddings(spark, sf)
    near = knn.knn_join(e, e, 5, method="lsh").select("tile_id", "neighbor_id", F.lit(1).alias("hit"))
    both = knn.knn_join(e, e, 5).join(near, ["tile_id", "neighbor_id"], "left")
    total = near.agg(F.count("*").alias("found"), F.count_distinct("tile_id").alias("n"))
    share = both.agg((F.count("hit") / F.count("*")).alias("recall"))
    return total.select("n", "found", (share.scalar() >= 0.9).alias("enough"))


@query(
    "scaled_embeddings",
    f"""with {EMB}, u as (select tile_id, unnest(range(len(embedding))) d, unnest(embedding)::double v from emb),
        s as (select d, avg(v) m, stddev_pop(v) s from u group by d)
        select tile_id, round(sum((v - m) / s * (d + 1)), 5) weighted, round(sum(((v - m) / s) ** 2), 5) square from u join s using (d) group by tile_id""",
)
def scaled_embeddings(spark, sf):
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "standard_scaler")
    w = F.aggregate(F.transform("emb", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    q = F.aggregate("emb", F.lit(0.0), lambda a, v: a + v * v)
    return out.select("tile_id", _r(w, "weighted", 5), _r(q, "square", 5))


@query(
    "pca_total_variance",
    f"""with {EMB}, u as (select unnest(range(len(embedding))) d, unnest(embedding)::double v from emb)
        select 64::bigint n, round(sum(v), 6) total, 1.0::double ratio from (select d, var_samp(v) v from u group by d)""",
)
def pca_total_variance(spark, sf):
    model = transforms.fit_pca(inputs.embeddings(spark, sf))
    rows = [(len(model.explained_variance), float(model.explained_variance.sum()), float(model.explained_variance_ratio.sum()))]
    return spark.createDataFrame(rows, "n long, total double, ratio double").select("n", _r("total"), _r("ratio"))


@query(
    "pca_keeps_lengths",
    f"""with {EMB}, u as (select tile_id, unnest(range(len(embedding))) d, unnest(embedding)::double v from emb), m as (select d, avg(v) m from u group by d)
        select tile_id, round(sum((v - m) ** 2), 6) square from u join m using (d) group by tile_id""",
)
def pca_keeps_lengths(spark, sf):
    """All components together only turn the centred vectors."""
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "pca")
    return out.select("tile_id", _r(F.aggregate("emb", F.lit(0.0), lambda a, v: a + v * v), "square"))


@query("pca_projection")
def pca_projection(spark, sf):
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "pca", n_components=4)
    return out.select("tile_id", *[_r(F.col("emb")[k], f"c{k}", 5) for k in range(4)], "transform_extra_args")


@query("pca_explained_variance")
def pca_explained_variance(spark, sf):
    from tilequery.operators.stats import cumulative_variance

    _, model = transforms.apply_transform(inputs.embeddings(spark, sf), "pca", n_components=8)
    return cumulative_variance(model.variance_table(spark)).select("component", _r("explained_variance"), _r("cumulative", digits=2))


@query(
    "cumulative_variance",
    f"""with {EMB}, u as (select unnest(range(len(embedding)))::int component, unnest(embedding)::double v from emb),
        r as (select component, round(var_samp(v) / sum(var_samp(v)) over (), 6) explained_variance from u group by component)
        select component, explained_variance, round(sum(round(explained_variance, 2)) over (order by component), 2) cumulative from r""",
)
def cumulative_variance(spark, sf):
    """Running share of the total variance over the plain components."""
    from tilequery.operators.select import explode_dims
    from tilequery.operators.stats import cumulative_variance as running

    v = explode_dims(inputs.embeddings(spark, sf)).withColumn("value", F.col("value").cast("double"))
    per = v.groupBy(F.col("emb_dim").alias("component")).agg(F.var_samp("value").alias("var"))
    share = F.round(F.col("var") / per.agg(F.sum("var")).scalar(), 6)
    return running(per.select("component", share.alias("explained_variance"))).select("component", "explained_variance", _r("cumulative", digits=2))


@query("kmeans_labels")
def kmeans_labels(spark, sf):
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "kmeans", k=8, seed=1)
    return out.select("tile_id", "label")


def _merging(total: str, cost: str = "d") -> str:
    """Recursive SQL that merges the two nearest clusters again and again; keyed by cluster, a row of distances each.

    ``total`` is the distance of the merged cluster to cluster j, given ``v`` and ``two.d[j]``; merge k stays in row ``-1 - k``.
    """
    return f"""recursive e as materialized (select row_number() over (order by vec_id) i, vec_id, embedding::double[] v from embeddings),
        t(i, d, n, l, k) using key (i) as (
          select x.i, list(case when x.i <> y.i then list_distance(x.v, y.v) end order by y.i), 1::bigint, [any_value(x.vec_id)], any_value(x.vec_id) - 1000000000000
          from e x, e y group by x.i
          union
          (with now as materialized (select * from recurring.t where i > 0),
                z as materialized (select list(n order by i) ns from now),
                c as materialized (select now.i, n, d, {cost} h from now, z where n > 0),
                b as materialized (select i x, list_position(h, list_min(h)) y, list_min(h) h from c where list_min(h) is not null order by h, x limit 1),
                p as materialized (
                  select b.x, b.y, b.h, one.n + two.n n, list_transform(one.d, lambda v, j: case when j not in (b.x, b.y) then {total} end) d,
                         case when one.k < two.k then one.l || two.l else two.l || one.l end l, (select count(*) from recurring.t where i < 0) k
                  from b join now one on one.i = b.x join now two on two.i = b.y cross join z)
           select x, d, n, l, k from p
           union all select y, null, 0, null, null from p
           union all select now.i, list_transform(now.d, lambda v, j: case when j = x then p.d[now.i] when j <> y then v end), now.n, now.l, now.k
                     from now, p where now.n > 0 and now.i not in (x, y)
           union all select -1 - k, [h], n, l, k from p))"""


_COMPLETE = _merging("greatest(v, two.d[j])")
_AVERAGE = _merging("v + two.d[j]", "list_transform(d, lambda v, j: v / (n * ns[j]))")
_SINGLE = _merging("least(v, two.d[j])")
_WARD = _merging("sqrt(((one.n + ns[j]) * v * v + (two.n + ns[j]) * two.d[j] * two.d[j] - ns[j] * b.h * b.h) / (one.n + two.n + ns[j]))")
_HEIGHTS = "select k::bigint step, round(d[1], 6) height, n size from t where i < 0"
_PLACES = "select unnest(l) tile_id, unnest(range(len(l)))::bigint place from t where i < 0 and n = (select count(*) from embeddings)"
#: clusters of the cut to 14, numbered by leaf order
_CUT = f"""place as ({_PLACES}), u as (select k, unnest(l) tile_id from t where i < 0 and k < (select count(*) from embeddings) - 14),
        o as (select tile_id, place, max(k) k from place left join u using (tile_id) group by all),
        f as (select tile_id, case when k is null then place else min(place) over (partition by k) end f from o),
        q as (select tile_id, (dense_rank() over (order by f) - 1)::int cluster_id from f)"""


@query("ward_clusters", f"with {_WARD}, {_CUT} select tile_id, cluster_id, chr(65 + cluster_id) cluster_label from q")
def ward_clusters(spark, sf):
    return linkage.agglomerate(inputs.embeddings(spark, sf), 14, "ward", letters=True)


@query(
    "single_linkage_heights",
    f"""with recursive e as (select vec_id i, embedding::double[] v from embeddings),
        d as materialized (select a.i a, b.i b, list_distance(a.v, b.v) d from e a join e b on a.i <> b.i),
        near as (select count(*) n, round(sum(m), 6) total from (select a, min(d) m from d group by a))
        select n::bigint n, total from near""",
)
def single_linkage_heights(spark, sf):
    """The spanning tree holds every tile's shortest edge: their sum is read from the tree."""
    tree = linkage.linkage(inputs.embeddings(spark, sf), "single")
    ends = tree.select(F.explode(F.array("node", "parent")).alias("tile_id"), "height")
    low = ends.groupBy("tile_id").agg(F.min("height").alias("low"))
    return low.agg(F.count("*").alias("n"), _r(F.sum("low"), "total"))


@query("single_linkage_clusters", f"with {_SINGLE}, {_CUT} select tile_id, cluster_id, cluster_id::varchar cluster_label from q")
def single_linkage_clusters(spark, sf):
    return linkage.agglomerate(inputs.embeddings(spark, sf), 14, "single")


def _heights(spark, sf, method):
    merges = linkage.linkage(inputs.embeddings(spark, sf), method)
    return numbered(merges, "height", "node", name="step").select("step", _r("height"), "size")


@query("complete_linkage_heights", f"with {_COMPLETE} {_HEIGHTS}")
def complete_linkage_heights(spark, sf):
    """Every merge of complete linkage by height, with the size of what it makes."""
    return _heights(spark, sf, "complete")


@query("average_linkage_heights", f"with {_AVERAGE} {_HEIGHTS}")
def average_linkage_heights(spark, sf):
    return _heights(spark, sf, "average")


@query("leaf_order", f"with {_AVERAGE} {_PLACES}")
def leaf_order(spark, sf):
    """All tiles from left to right below the tree of average linkage."""
    e = inputs.embeddings(spark, sf)
    return linkage.leaf_order(e, linkage.linkage(e, "average"))


#: mutual reachability, spanning tree (Prim), its edges merged one by one with the clusters they make, choice by excess of mass
_HDBSCAN = """recursive e as (select vec_id i, embedding::double[] v from embeddings),
        d as materialized (select a.i a, b.i b, list_distance(a.v, b.v) d from e a join e b on a.i <> b.i),
        core as materialized (select a, d core from (select a, d, row_number() over (partition by a order by d) r from d) where r = {samples}),
        w as materialized (select d.a, d.b, greatest(d, x.core, y.core) w from d join core x on x.a = d.a join core y on y.a = d.b),
        prim(v, done, w, near) using key (v) as (
          select b, false, w, a from w where a = (select min(i) from e)
          union select min(i), true, 0.0, null from e
          union
          (with m as materialized (select v x, w c, near from recurring.prim where not done order by w, least(v, near), greatest(v, near) limit 1)
           select x, true, c, near from m
           union all select p.v, false, n.w, m.x from recurring.prim p, m, w n
                     where not p.done and p.v <> m.x and n.a = m.x and n.b = p.v
                       and (n.w, least(n.a, n.b), greatest(n.a, n.b)) < (p.w, least(p.v, p.near), greatest(p.v, p.near)))),
        edges as materialized (select row_number() over (order by w, u, v) - 1 r, u, v, 1 / w lam
                               from (select least(v, near) u, greatest(v, near) v, w from prim where near is not null)),
        cond(v, comp, size, cc, cl, lam, top) using key (v) as (
          select i, i, 1::bigint, null::bigint, null::bigint, null::double, null::bigint from e
          union select -1, null, 0, null, null, null, null
          union
          (with m as materialized (
             select r, g.lam, a.comp ca, b.comp cb, a.cc xa, b.cc xb, a.size + b.size n, a.cc is not null and b.cc is not null twin,
                    case when a.cc is not null and b.cc is not null then r when a.size + b.size >= {least} then coalesce(a.cc, b.cc, r) end cc
             from recurring.cond s join edges g on s.v = -1 and g.r = s.size join recurring.cond a on a.v = g.u join recurring.cond b on b.v = g.v)
           select p.v, least(ca, cb), n, m.cc, coalesce(p.cl, m.cc), case when p.cl is null and m.cc is not null then m.lam else p.lam end, null
           from recurring.cond p, m where p.v >= 0 and p.comp in (ca, cb)
           union all select -1, null, r + 1, null, null, null, null from m
           union all select -2 - r, null, n, null, twin::bigint, lam, r from m where cc = r
           union all select p.v, r, p.size, null, p.cl, p.lam, p.top from recurring.cond p, m where twin and p.v in (-2 - xa, -2 - xb)
           union all select p.v, p.comp, p.size, null, p.cl, p.lam, r from recurring.cond p, m where not twin and m.cc <> m.r and p.v = -2 - m.cc)),
        c as materialized (select -2 - v c, comp parent, size, cl twin, lam death, top from cond where v <= -2),
        g as materialized (select c.c, c.parent, c.death, c.top, coalesce(q.death, 0) birth, c.twin * c.size * (c.death - coalesce(q.death, 0)) gain from c left join c q on q.c = c.parent),
        k as materialized (select g.*, gain + (select coalesce(sum(lam - g.birth), 0) from cond where v >= 0 and cl = g.c) stab from g),
        eom(c, within, best, done) using key (c) as (
          select c, 0.0::double, null::double, false from k
          union
          (with m as materialized (select k.c, k.parent, z.within, greatest(k.stab, z.within) best from recurring.eom z join k using (c) where not z.done order by k.c limit 1)
           select c, within, best, true from m
           union all select z.c, z.within + m.best, null, false from recurring.eom z join m on z.c = m.parent)),
        own as (select c, null::bigint owner from k where parent is null
                union all select k.c, coalesce(own.owner, case when k.stab >= eom.within then k.c end) from own join k on k.parent = own.c join eom on eom.c = k.c),
        lab as (select own.c, k.death, (dense_rank() over (order by k.top) - 1)::int label from own join k on k.c = own.owner)
        select v tile_id, coalesce(label, -1) label, round(coalesce(least(lam, death) / death, 0), 6)::double probability from cond left join lab on lab.c = cond.cl where v >= 0"""


@query("hdbscan_labels", "with " + _HDBSCAN.format(samples=3, least=5))
def hdbscan_labels(spark, sf):
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "hdbscan", min_cluster_size=5, min_samples=3)
    return out.select("tile_id", "label", _r("probability"))


@query("pca_hdbscan_labels")
def pca_hdbscan_labels(spark, sf):
    out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), "pca_hdbscan", pca__n_components=4, min_cluster_size=5)
    return out.select("tile_id", "label", _r("probability"))


@query(
    "core_distances",
    f"""with {EMB}, e as (select tile_id, embedding::double[] v from emb),
        d as (select a.tile_id, list_distance(a.v, b.v) dist from e a join e b on a.tile_id <> b.tile_id),
        r as (select *, row_number() over (partition by tile_id order by dist) r from d) select tile_id, round(dist, 6) core from r where r = 5""",
)
def core_distances(spark, sf):
    c = density.core_distances(inputs.embeddings(spark, sf), 5)
    return c.select(F.col("id").alias("tile_id"), _r("w", "core"))


def _projection(kind: str, **kwargs):
    def run(spark, sf):
        out, _ = transforms.apply_transform(inputs.embeddings(spark, sf), kind, **kwargs)
        return out.select("tile_id", *[_r(F.col("emb")[k], f"c{k}", 5) for k in range(2)], "transform_type")

    return run


query("isomap_projection")(_projection("isomap", n_neighbors=5))
query("lle_projection")(_projection("lle", n_neighbors=8))
query("ltsa_projection")(_projection("ltsa", n_neighbors=8))
query("hessian_lle_projection")(_projection("hessian_lle", n_neighbors=8))
query("modified_lle_projection")(_projection("modified_lle", n_neighbors=8))
query("mds_projection")(_projection("mds"))
query("tsne_projection")(_projection("tsne"))


@query(
    "one_cycle_schedule",
    """with n as (select ceil(count(*) / 32)::int s from embeddings), p as (select s, 5 * s total, 0.3 * 5 * s - 1.0 peak from n),
       t as (select unnest(range(total))::int step, * from p)
       select step, (step // s)::int epoch,
              round(case when step <= peak then 0.01 + (0.0004 - 0.01) / 2 * (1 + cos(pi() * step / peak))
                    else 0.00000004 + (0.01 - 0.00000004) / 2 * (1 + cos(pi() * (step - peak) / (total - 1 - peak))) end, 9) lr,
              round(case when step <= peak then 0.85 + 0.05 * (1 + cos(pi() * step / peak))
                    else 0.95 - 0.05 * (1 + cos(pi() * (step - peak) / (total - 1 - peak))) end, 6) momentum from t""",
)
def one_cycle_schedule(spark, sf):
    steps = -(-inputs.embeddings(spark, sf).count() // 32)
    return training.one_cycle(spark, 0.01, 5, steps).select("step", "epoch", _r("lr", digits=9), _r("momentum"))


@query("head_training_metrics")
def head_training_metrics(spark, sf):
    _, metrics = training.fit_head(inputs.wide(spark, sf), dims=16, epochs=2, n_batches=4)
    return metrics.select("epoch", "step", "split", _r("loss", digits=4), _r("l_near", digits=4), _r("l_distant", digits=4))


@query("cluster_samples_before_and_after")
def cluster_samples_before_and_after(spark, sf):
    w = inputs.wide(spark, sf)
    model, _ = training.fit_head(w, dims=16, epochs=1, n_batches=2)
    parts = {t: F.col(f"_{t}") for t in ("anchor", "neighbor", "distant")}
    after = w
    for t in parts:
        after = model.transform(after, t, f"_{t}")
    return linkage.compare_versions(w, after.withColumns(parts).drop(*[f"_{t}" for t in parts]), 6, 5)


@query("streamed_scene_embeddings", f"with {CROP_MEANS} select scene_id, i + 8 i0, j + 8 j0, round(list_sum(r) / 256 / 255, 4)::double e0 from q")
def streamed_scene_embeddings(spark, sf):
    from tilequery.streaming.scenes import scene_stream, stream_scenes

    root = scratch_path(spark)
    inputs.page_scenes(spark, sf).write.parquet(f"{root}/scenes")
    run = stream_scenes(scene_stream(spark, f"{root}/scenes", "parquet"), channel_means, f"{root}/out", f"{root}/state", (8, 8), (16, 16))
    run.awaitTermination()
    out = spark.read.schema("scene_id long, j int, i int, embedding array<float>, i0 int, j0 int").parquet(f"{root}/out")
    return out.select("scene_id", "i0", "j0", _r(F.col("embedding")[0].cast("double"), "e0", 4))
