"""Triplets, distances, losses and their distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequery.functions.vectors import norm
from tilequery.operators import select as sel
from tilequery.operators import stats, triplets
from tilequery.plans import inputs
from tilequery.plans.inputs import EMB, WIDE
from tilequery.plans.registry import query


def _r(c, name=None, digits=6):
    return F.round(c, digits).alias(name or c)


def distances(spark, sf):
    w = triplets.pair_distance(inputs.wide(spark, sf), "anchor", "neighbor", "l2", "an_dist")
    w = triplets.pair_distance(w, "anchor", "distant", "l2", "ad_dist")
    return w.select("tile_id", "label", "an_dist", "ad_dist")


@query(
    "triplet_loss_by_label",
    f"""with {WIDE},
        d as (select label, list_distance(anchor, neighbor) ** 2 n, list_distance(anchor, distant) ** 2 f from wide)
        select label, round(avg(greatest(n - f + 1.0, 0)), 6) loss, round(avg(n), 6) l_near, round(avg(f), 6) l_distant
        from d group by label""",
)
def triplet_loss_by_label(spark, sf):
    out = triplets.triplet_loss(inputs.wide(spark, sf), 1.0, ["label"])
    return out.select("label", _r("loss"), _r("l_near"), _r("l_distant"))


@query(
    "triplet_squared_distances",
    f"""with {WIDE} select tile_id, label, round(list_distance(anchor, neighbor) ** 2, 6) l_near,
        round(list_distance(anchor, distant) ** 2, 6) l_distant from wide""",
)
def triplet_squared_distances(spark, sf):
    d = triplets.triplet_distances(inputs.wide(spark, sf))
    return d.select("tile_id", "label", _r("l_near"), _r("l_distant"))


@query(
    "triplet_loss_with_norm_penalty",
    f"""with {WIDE}
        select label, round(avg(greatest(list_distance(anchor, neighbor) - list_distance(anchor, distant) + 1.0, 0))
               + 0.01 * (sqrt(sum(list_dot_product(anchor, anchor))) + sqrt(sum(list_dot_product(neighbor, neighbor)))
                         + sqrt(sum(list_dot_product(distant, distant)))), 6) loss,
               round(avg(list_distance(anchor, neighbor)), 6) l_near, round(avg(-list_distance(anchor, distant)), 6) l_distant
        from wide group by label""",
)
def triplet_loss_with_norm_penalty(spark, sf):
    out = triplets.triplet_loss_norm(inputs.wide(spark, sf), 1.0, 0.01, ["label"])
    return out.select("label", _r("loss"), _r("l_near"), _r("l_distant"))


@query("anchor_pair_distances", f"with {WIDE} select tile_id, label, round(an_dist, 6) an_dist, round(ad_dist, 6) ad_dist from dist")
def anchor_pair_distances(spark, sf):
    return distances(spark, sf).select("tile_id", "label", _r("an_dist"), _r("ad_dist"))


@query(
    "vector_norms",
    f"""with {EMB}, e as (select tile_id, embedding::double[] v from emb)
        select tile_id, round(list_sum(list_transform(v, lambda x: abs(x))), 6) l1,
               round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) l2,
               round(list_max(list_transform(v, lambda x: abs(x))), 6) linf,
               round(pow(list_sum(list_transform(v, lambda x: pow(abs(x), 3.0))), 1.0 / 3.0), 6) l3 from e""",
)
def vector_norms(spark, sf):
    e = inputs.embeddings(spark, sf)
    orders = {"l1": 1, "l2": 2, "linf": float("inf"), "l3": 3}
    return e.select("tile_id", *[_r(norm("embedding", o), n) for n, o in orders.items()])


@query(
    "wide_from_long_triplets",
    f"""with {WIDE} select tile_id, round(list_sum(anchor), 6) a, round(list_sum(neighbor), 6) n, round(list_sum(distant), 6) d from wide""",
)
def wide_from_long_triplets(spark, sf):
    w = triplets.wide_triplets(sel.union_types(*[sel.of_type(inputs.long(spark, sf), t) for t in ("anchor", "neighbor", "distant")]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return w.select("tile_id", *[_r(total(c), c[0]) for c in ("anchor", "neighbor", "distant")])


@query("tiles_near_their_neighbour", f"with {WIDE} select tile_id, round(an_dist, 6) an_dist from dist where an_dist < 1.35")
def tiles_near_their_neighbour(spark, sf):
    return sel.near_only(distances(spark, sf), 1.35).select("tile_id", _r("an_dist"))


@query(
    "distance_ecdf",
    f"""with {WIDE}, s as (select round(an_dist, 3) value, count(*) n from dist group by 1)
        select value, n, round(sum(n) over (order by value) / (select count(*) from dist), 6) cdf from s""",
)
def distance_ecdf(spark, sf):
    d = distances(spark, sf).select(F.round("an_dist", 3).alias("an_dist"))
    return stats.ecdf(d, "an_dist").select("value", "n", _r("cdf"))


@query(
    "distance_inverse_ecdf",
    f"""with {WIDE}, s as (select an_dist value, count(*) n from dist group by 1),
        c as (select value, sum(n) over (order by value) / (select count(*) from dist) f from s),
        p as (select unnest([0.1, 0.3, 0.5, 0.9]) p),
        b as (select p, max(f) filter (f <= p) f0, max(value) filter (f <= p) v0, min(f) filter (f >= p) f1, min(value) filter (f >= p) v1
              from p, c group by p)
        select p::double p, round(case when f1 = f0 then v0 else v0 + (p - f0) / (f1 - f0) * (v1 - v0) end, 6) an_dist from b""",
)
def distance_inverse_ecdf(spark, sf):
    d = distances(spark, sf)
    ps = [0.1, 0.3, 0.5, 0.9]
    return spark.createDataFrame(list(zip(ps, stats.inverse_ecdf(d, "an_dist", ps))), "p double, an_dist double").select("p", _r("an_dist"))


@query(
    "distance_histograms",
    f"""with {WIDE}, v as (select 'an_dist' kind, an_dist v from dist union all select 'ad_dist', ad_dist from dist),
        b as (select kind, least(floor(v / (2.0 / 25)), 24)::int bin, count(*) n from v where v between 0 and 2.0 group by all),
        k as (select * from (values ('an_dist'), ('ad_dist')) k(kind), range(25) r(bin))
        select k.kind, k.bin::int bin, round(k.bin * (2.0 / 25), 6)::double left_edge, coalesce(b.n, 0)::bigint n
        from k left join b on k.kind = b.kind and k.bin = b.bin""",
)
def distance_histograms(spark, sf):
    return stats.distance_histograms(distances(spark, sf), 0.4).select("kind", "bin", _r("left_edge"), "n")


CATALOG = "cat as (select vec_id triplet_id, t tile_type, printf('%05d_%s.png', vec_id, t) filepath, label from embeddings, (values ('anchor'), ('neighbor'), ('distant')) x(t))"


def catalogue(spark, sf):
    """Tile catalogue whose file names are built from, and parsed back into, ids and types."""
    from tilequery.functions.names import TRIPLET_NAME, format_name, name_matches, parse_name

    types = F.explode(F.array(*[F.lit(t) for t in ("anchor", "neighbor", "distant")]))
    files = inputs.embeddings(spark, sf).select(F.col("tile_id").alias("triplet_id"), types.alias("tile_type"), "label").select(
        format_name(TRIPLET_NAME, "png").alias("filepath"), "label"
    )
    name = F.col("filepath")
    parsed = parse_name(name, TRIPLET_NAME, "png")
    return files.filter(name_matches(name, TRIPLET_NAME, "png")).select(
        *[c.alias(n) for n, c in parsed.items()], "filepath", "label"
    )


@query("catalogue_by_name", f"with {CATALOG} select * from cat")
def catalogue_by_name(spark, sf):
    return catalogue(spark, sf)


@query("files_in_order", f"with {CATALOG} select filepath, (row_number() over (order by filepath) - 1)::bigint place from cat")
def files_in_order(spark, sf):
    """The catalogue in order of its file names."""
    from tilequery.sources import catalog

    return catalog.files_in_order(catalogue(spark, sf), "filepath").select("filepath", "place")


@query(
    "catalogue_triplets",
    f"""with {CATALOG} select triplet_id tile_id, max(filepath) filter (tile_type = 'anchor') anchor,
        max(filepath) filter (tile_type = 'neighbor') neighbor, max(filepath) filter (tile_type = 'distant') distant
        from cat where not (tile_type = 'distant' and label = 9) group by 1 having count(*) = 3""",
)
def catalogue_triplets(spark, sf):
    gaps = catalogue(spark, sf).filter("not (tile_type = 'distant' and label = 9)")
    w = triplets.triplets(gaps, on_incomplete="skip")
    return w.select("tile_id", *[F.col(f"{t}.filepath").alias(t) for t in ("anchor", "neighbor", "distant")])


@query("catalogue_singlets", f"with {CATALOG} select triplet_id tile_id, filepath, label from cat where tile_type = 'anchor' and label < 5")
def catalogue_singlets(spark, sf):
    return triplets.singlets(catalogue(spark, sf), "ANCHOR", lambda t: t.filter("label < 5")).select("tile_id", "filepath", "label")


@query(
    "catalogue_zipped_types",
    f"""with {CATALOG}, r as (select tile_type, filepath, row_number() over (partition by tile_type order by filepath) - 1 pos from cat)
        select pos, max(filepath) filter (tile_type = 'anchor') anchor, max(filepath) filter (tile_type = 'neighbor') neighbor,
        max(filepath) filter (tile_type = 'distant') distant from r group by pos""",
)
def catalogue_zipped_types(spark, sf):
    return triplets.zip_types(catalogue(spark, sf))


@query(
    "catalogue_with_sidecar",
    f"""with {CATALOG}, side as (select printf('%05d_anchor.png', doc_id) filepath, quality from labels)
        select cat.filepath, quality from cat left join side on cat.filepath = side.filepath""",
)
def catalogue_with_sidecar(spark, sf):
    from tilequery.sources.catalog import attach_sidecar

    side = inputs.table(spark, sf, "labels").select(F.format_string("%05d_anchor.png", "doc_id").alias("filepath"), "quality")
    return attach_sidecar(catalogue(spark, sf), side, "if_available").select("filepath", "quality")


@query(
    "catalogue_missing_files",
    f"""with {CATALOG}, seen as (select printf('%05d_anchor.png', doc_id) filepath from labels)
        select filepath from cat where filepath not in (select filepath from seen)""",
)
def catalogue_missing_files(spark, sf):
    seen = inputs.table(spark, sf, "labels").select(F.format_string("%05d_anchor.png", "doc_id").alias("filepath"))
    return sel.missing_files(catalogue(spark, sf), seen).select("filepath")
