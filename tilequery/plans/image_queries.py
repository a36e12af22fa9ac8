"""Pixels, measures and embeddings of pictures derived from the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilequery.functions import pixels
from tilequery.operators import augment as aug
from tilequery.operators import embed, manifold, measures, stats, tiling, transforms
from tilequery.plans import inputs
from tilequery.plans.inputs import FLAT, PAGE_HEX, PIXELS
from tilequery.plans.registry import query
from tilequery.plans.triplet_queries import _r
from tilequery.session import materialize


@query(
    "pixel_channel_stats",
    f"""with {PIXELS}, c as (select 0 channel, r / 255 v from px union all select 1, g / 255 from px union all select 2, b / 255 from px)
        select channel, round(avg(v), 6) mean, round(stddev_samp(v), 6) std from c group by channel""",
)
def pixel_channel_stats(spark, sf):
    m = inputs.images(spark, sf).select(pixels.moments().alias("m"))
    return stats.channel_stats(m).select("channel", _r("mean"), _r("std"))


@query("blank_tiles", f"with {PIXELS} select tile_id, least(min(r), min(g)) = greatest(max(r), max(g)) blank from px group by tile_id")
def blank_tiles(spark, sf):
    return inputs.images(spark, sf).select("tile_id", pixels.is_blank().alias("blank"))


@query(
    "grey_levels",
    f"""with {PIXELS} select tile_id, round(avg((r * .2125 + g * .7154 + b * .0721) / 255), 6) light,
        sum((r * 299 + g * 587 + b * 114 + 500)::bigint // 1000)::double level from px group by tile_id""",
)
def grey_levels(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return inputs.images(spark, sf).select(
        "tile_id", _r(total(pixels.to_grey("luma709")) / 64, "light"), total(pixels.to_grey("luma601")).alias("level")
    )


@query(
    "stretched_levels",
    f"""with {PIXELS}, v as (select tile_id, (r * 299 + g * 587 + b * 114 + 500)::bigint // 1000 v from px),
        l as (select *, min(v) over (partition by tile_id) lo, max(v) over (partition by tile_id) hi from v)
        select tile_id, sum(trunc((v - lo)::double / (hi - lo) * 255))::bigint total from l group by tile_id""",
)
def stretched_levels(spark, sf):
    s = pixels.to_uint8(pixels.to_grey("luma601"))
    return inputs.images(spark, sf).select("tile_id", F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(
    "normalized_pixels",
    f"""with {PIXELS} select tile_id, round(sum((r / 255 - 0.485) / 0.229 + (g / 255 - 0.456) / 0.224 + (b / 255 - 0.406) / 0.225), 1) total,
        round(sum(r + g + b) / 255, 1) restored from px group by tile_id""",
)
def normalized_pixels(spark, sf):
    st = pixels.backbone_stats("resnet18")
    t = aug.image_chain(inputs.images(spark, sf), "predict")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return t.select("tile_id", _r(total("tensor"), "total", 1), _r(total(pixels.normalize(st, inverse=True)(F.col("tensor"))), "restored", 1))


@query(
    "tile_thumbnails",
    f"""with {PIXELS} select tile_id, 4 h, string_agg(printf('%02X%02X%02X', r::int, g::int, b::int), '' order by p) hx
        from px where p % 8 % 2 = 0 and p // 8 % 2 = 0 group by tile_id""",
)
def tile_thumbnails(spark, sf):
    t = inputs.images(spark, sf).select("tile_id", pixels.thumbnail(4).alias("t"))
    return t.select("tile_id", F.col("t.h").alias("h"), F.hex("t.pixels").alias("hx"))


def _binned(spark, sf):
    f = inputs.flat(spark, sf)
    blank = inputs.images(spark, sf).select("tile_id", (pixels.is_blank() | (F.pmod("tile_id", F.lit(7)) == 0)).alias("blank"))
    return f.join(blank, "tile_id")


#: every seventh tile counts as blank, so that the picks have something to skip
BLANK_BINS = f"""{FLAT}, b as (select *, tile_id % 7 = 0 blank, trunc((x + 0.4) / 0.1)::int ix, trunc((y + 0.4) / 0.1)::int iy from flat),
     best as (select ix, iy, count(*) n_tiles, arg_min(tile_id, an_dist) filter (not blank) tile_id from b
              where ix between 0 and 7 and iy between 0 and 7 group by ix, iy having count(*) >= 2)"""


@query("bins_without_blank_tiles", f"with {BLANK_BINS} select * from best")
def bins_without_blank_tiles(spark, sf):
    return manifold.bin_manifold(_binned(spark, sf), 0.8, 8, 2).drop("an_dist")


@query("best_nonblank_per_label", f"with {BLANK_BINS} select label, arg_min(tile_id, an_dist) filter (not blank) tile_id from b group by label")
def best_nonblank_per_label(spark, sf):
    return manifold.best_nonblank(_binned(spark, sf), ["label"]).select("label", "tile_id")


@query(
    "manifold_mosaic",
    f"""with {BLANK_BINS}, {PIXELS}, t as (select tile_id, string_agg(printf('%02X%02X%02X', r::int, g::int, b::int), '' order by p) hx
                                          from px where p % 8 % 2 = 0 and p // 8 % 2 = 0 group by tile_id)
        select ix, iy, 7 - iy as row, ix as col, tile_id, hx from best join t using (tile_id)""",
)
def manifold_mosaic(spark, sf):
    bins = manifold.bin_manifold(_binned(spark, sf), 0.8, 8, 2)
    m = manifold.mosaic(bins, inputs.images(spark, sf), 8, 4)
    return m.select("ix", "iy", "row", "col", "tile_id", F.hex("thumb.pixels").alias("hx"))


CROPS = f"""{PAGE_HEX}, w as (select scene_id, i::int i, j::int j, hx from pic, range(0, 17, 8) a(i), range(0, 4096, 8) b(j) where j <= h - 16),
     crop as (select scene_id, i, j, list_aggregate(list_transform(range(16), lambda r: substr(hx, ((j + r) * 32 + i) * 6 + 1, 96)), 'string_agg', '') hx from w)"""


@query("scene_window_crops", f"with {CROPS} select scene_id, i, j, printf('%05d_%05d.png', i + 8, j + 8) as name, md5(hx) key from crop")
def scene_window_crops(spark, sf):
    from tilequery.functions.names import CROP_NAME, format_name

    crops = tiling.with_centres(tiling.crop_scenes(inputs.page_scenes(spark, sf), (8, 8), (16, 16)), (16, 16))
    return crops.select("scene_id", "i", "j", format_name(CROP_NAME, "png").alias("name"), F.md5(F.hex("pixels").cast("binary")).alias("key"))


# --- measures -----------------------------------------------------------------

MASK = f"""{PIXELS}, grey as (select tile_id, p, (r * 299 + g * 587 + b * 114 + 500)::bigint // 1000 v from px)"""
OBJECTS = f"""{MASK}, on_px as (select tile_id, p from grey where v > 120),
     reach as (select tile_id, p, p q from on_px union
               select r.tile_id, r.p, n.p from reach r join on_px n on n.tile_id = r.tile_id
               and ((abs(n.p - r.q) = 8) or (abs(n.p - r.q) = 1 and n.p // 8 = r.q // 8))),
     root as (select tile_id, p, min(q) root from reach group by all),
     obj as (select tile_id, root, count(*)::int n_px, avg(p // 8) as row, avg(p % 8) as col from root group by all)"""


@query("mask_objects", f"with recursive {OBJECTS} select tile_id, n_px, round(row, 6) as row, round(col, 6) as col from obj")
def mask_objects(spark, sf):
    return measures.tile_objects(inputs.images(spark, sf), 120).select("tile_id", "n_px", _r("row"), _r("col"))


@query(
    "tile_object_counts",
    f"with recursive {OBJECTS}, t as (select distinct tile_id from px) select t.tile_id, count(root)::int n_objects, coalesce(max(n_px), 0)::int largest from t left join obj using (tile_id) group by 1",
)
def tile_object_counts(spark, sf):
    return measures.measure_tiles(inputs.images(spark, sf), "object_counts", greyscale_threshold=120)


@query(
    "tile_organisation_iorg",
    f"""with recursive {OBJECTS}, nn as (select a.tile_id, a.root, min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) d2
                                         from obj a join obj b on a.tile_id = b.tile_id and a.root <> b.root group by all),
        k as (select tile_id, d2, row_number() over (partition by tile_id order by d2) k, count(*) over (partition by tile_id) n from nn),
        f as (select tile_id, 1 - exp(-n / 64.0 * pi() * d2) x, k / n y from k union all select distinct tile_id, 0.0, 0.0 from k union all select distinct tile_id, 1.0, 1.0 from k),
        s as (select tile_id, (lead(x) over w - x) * (lead(y) over w + y) / 2 a from f window w as (partition by tile_id order by x, y)),
        i as (select tile_id, round(sum(a), 6) iorg from s group by tile_id)
        select t.tile_id, iorg from (select distinct tile_id from px) t left join i using (tile_id)""",
)
def tile_organisation_iorg(spark, sf):
    return measures.iorg(inputs.images(spark, sf), 120).select("tile_id", _r("iorg"))


@query(
    "tile_organisation_scai",
    f"""with recursive {OBJECTS}, d as (select a.tile_id, exp(avg(ln(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)))) d0
                                        from obj a join obj b on a.tile_id = b.tile_id and a.root < b.root group by all),
        n as (select tile_id, count(*) n from obj group by all)
        select t.tile_id, round(n / 32.0 * d0 / 8 * 1000, 6) scai from (select distinct tile_id from px) t left join d using (tile_id) left join n using (tile_id)""",
)
def tile_organisation_scai(spark, sf):
    return measures.scai(inputs.images(spark, sf), 120).select("tile_id", _r("scai"))


@query(
    "threshold_sweep",
    f"""with {MASK} select tile_id, t::double threshold, (count(*) filter (v > t) / 64)::double masked_fraction from grey, range(30, 200, 10) s(t) group by all""",
)
def threshold_sweep(spark, sf):
    return measures.threshold_sweep(inputs.images(spark, sf)).select("tile_id", "threshold", "masked_fraction")


# --- embedding ----------------------------------------------------------------


def channel_means():
    """A plain stand-in model: mean level of each channel."""
    return lambda x: x.reshape(x.shape[0], 3, -1).mean(axis=2, dtype=np.float64)


@query("tile_embeddings", f"with {PIXELS} select tile_id, round(avg(r) / 255, 5) e0, round(avg(g) / 255, 5) e1, round(avg(b) / 255, 5) e2 from px group by tile_id")
def tile_embeddings(spark, sf):
    e = embed.embed(inputs.images(spark, sf), channel_means)
    return e.select("tile_id", *[_r(F.col("embedding")[k].cast("double"), f"e{k}", 5) for k in range(3)])


@query("tile_embeddings_encoder")
def tile_embeddings_encoder(spark, sf):
    e = embed.embed(inputs.images(spark, sf), embed.block_encoder(100))
    return e.select("tile_id", F.size("embedding").alias("dims"), _r(F.col("embedding")[0].cast("double"), "e0", 5))


CROP_MEANS = f"""{CROPS}, q as (select scene_id, i, j, list_transform(range(256), lambda k: ('0x' || substr(hx, (k * 6 + 1)::bigint, 2))::int) r from crop)"""


@query("scene_embedding_map", f"with {CROP_MEANS} select scene_id, i + 8 i0, j + 8 j0, 16 tile_nx, round(list_sum(r) / 256 / 255, 4)::double e0 from q")
def scene_embedding_map(spark, sf):
    e = embed.embed_scenes(inputs.page_scenes(spark, sf), channel_means, (8, 8), (16, 16))
    return e.select("scene_id", "i0", "j0", "tile_nx", _r(F.col("embedding")[0].cast("double"), "e0", 4))


@query(
    "scene_embedding_map_pending",
    f"with {CROP_MEANS} select scene_id, count(*) n from q where scene_id not in (select page_id from pages where url like '%a%') group by scene_id",
)
def scene_embedding_map_pending(spark, sf):
    done = inputs.table(spark, sf, "pages").filter("url like '%a%'").select(F.col("page_id").alias("scene_id"))
    e = embed.embed_pending_scenes(inputs.page_scenes(spark, sf), done, channel_means, step=(8, 8), tile=(16, 16))
    return e.groupBy("scene_id").agg(F.count("*").alias("n"))


@query(
    "trajectory_embeddings",
    f"""with {PAGE_HEX}, p as (select event_id, (user_id % (select count(*) from pages))::bigint scene_id, (value % 40)::int i, (event_id % 30)::int j from
                              (select event_id, user_id, floor(value)::bigint as value from events)),
        v as (select event_id, p.scene_id, i, j, h, hx, i between 8 and 24 and j between 8 and h - 8 ok from p left join pic using (scene_id)),
        c as (select event_id, {", ".join(f"list_sum(list_transform(range(256), lambda k: ('0x' || substr(hx, (((j - 8 + k // 16) * 32 + i - 8 + k % 16) * 6 + {2 * c + 1})::bigint, 2))::int)) s{c}" for c in range(3))} from v where ok)
        select event_id, p.scene_id, i, j, {", ".join(f"s{c}::double e{c}" for c in range(3))} from p left join c using (event_id)""",
)
def trajectory_embeddings(spark, sf):
    n = inputs.table(spark, sf, "pages").count()
    p = inputs.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % n).alias("scene_id"), (F.floor("value") % 40).cast("int").alias("i"), (F.col("event_id") % 30).cast("int").alias("j")
    )
    e = embed.embed_trajectories(p, inputs.page_scenes(spark, sf), channel_means, (16, 16))
    # the sum of a crop's 256 levels: whole numbers, so no rounding can differ
    return e.select("event_id", "scene_id", "i", "j", *[F.round(F.col("embedding")[c].cast("double") * (256 * 255)).alias(f"e{c}") for c in range(3)])


@query(
    "transforms_of_trajectory_embeddings",
    f"""with {PAGE_HEX}, p as (select event_id, (user_id % (select count(*) from pages))::bigint scene_id, (value % 40)::int i, (event_id % 30)::int j from
                              (select event_id, user_id, floor(value)::bigint as value from events)),
        v as (select event_id, i between 8 and 24 and j between 8 and h - 8 ok from p left join pic using (scene_id))
        select kind, count(*) n, count(*) filter (coalesce(ok, false)) n_transformed from v, (values ('kmeans'), ('pca'), ('standard_scaler')) k(kind) group by kind""",
)
def transforms_of_trajectory_embeddings(spark, sf):
    """Points outside a scene have NULL vectors: they stay, with a NULL result, in every transform."""
    n = inputs.table(spark, sf, "pages").count()
    p = inputs.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % n).alias("scene_id"), (F.floor("value") % 40).cast("int").alias("i"), (F.col("event_id") % 30).cast("int").alias("j")
    )
    rows = materialize(embed.embed_trajectories(p, inputs.page_scenes(spark, sf), channel_means, (16, 16)).select(F.col("event_id").alias("tile_id"), "embedding"))
    parts = []
    for kind, options, result in (("standard_scaler", {}, "emb"), ("pca", {"n_components": 2}, "emb"), ("kmeans", {"k": 3}, "label")):
        out, _ = transforms.apply_transform(rows, kind, **options)
        parts.append(out.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.count(result).alias("n_transformed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("augmented_tiles")
def augmented_tiles(spark, sf):
    t = aug.image_chain(inputs.images(spark, sf), "train", epoch=1, seed=2)
    return t.select("tile_id", F.size("tensor").alias("n"), _r(F.array_max("tensor").cast("double"), "top", 4))
