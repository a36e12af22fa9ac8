"""Edges the registered queries do not reach: guard rails, hot keys, split paths."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF, vectors
from pyspark.sql import functions as F

from tilequery.functions import names
from tilequery.operators import augment, embed, geo, manifold, measures, rasters, sampling, stats, tiling, transforms, triplets
from tilequery.operators import select as sel
from tilequery.plans import inputs


def test_numbered_with_a_hot_key(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11))
    rows = sel.numbered(df, "k", "id").orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(3000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_derived_triplets_over_many_buckets(spark, monkeypatch):
    import tilequery.operators.select as s

    e = inputs.table(spark, SF, "embeddings").withColumn("label", F.when(F.col("vec_id").between(100, 320), 3).otherwise(F.col("label")))
    want = {r["tile_id"]: (r["neighbor"], r["distant"]) for r in triplets.derive_triplets(e).collect()}
    monkeypatch.setattr(s, "BUCKET_ROWS", 23)
    got = {r["tile_id"]: (r["neighbor"], r["distant"]) for r in triplets.derive_triplets(e).collect()}
    assert got == want and len(got) == 500
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in e.collect())
    for n, (i, lab, _) in enumerate(rows):
        same = [v for j, m, v in rows if m == lab and j > i] or [v for j, m, v in rows if m == lab]
        other = [v for j, m, v in rows if m != lab and j > i] or [v for j, m, v in rows if m != lab]
        assert got[i] == (same[0], other[0])


def test_top_per_group_beyond_the_rule(spark):
    df = spark.range(5000).withColumn("g", F.lit(1)).withColumn("v", (F.col("id") * 7919) % 5000)
    top = sel.top_per_group(df, ["g"], ["v"], 1500)
    assert [r["v"] for r in top.orderBy("rank").collect()] == list(range(1500))


def test_inverse_ecdf_range(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    assert stats.inverse_ecdf(df, "v", 0.3) == pytest.approx(1.2)
    assert stats.inverse_ecdf(df, "v", [0.25, 1.0]) == pytest.approx([1.0, 8.0])
    for p in (0.1, 1.1):
        with pytest.raises(ValueError):
            stats.inverse_ecdf(df, "v", p)


def test_guard_rails(spark):
    df = vectors(spark, np.eye(3))
    with pytest.raises(ValueError):
        sel.of_type(df, "anchor")
    with pytest.raises(ValueError):
        triplets.wide_triplets(df)
    with pytest.raises(ValueError):
        sampling.sample_clusters(df.withColumn("cluster_id", F.lit(0)), 2, "best_triplets")
    with pytest.raises(NotImplementedError):
        sampling.sample_clusters(df, 2, "nearest")
    with pytest.raises(ValueError):
        rasters.make_rgb(df, [0, 1])
    with pytest.raises(NotImplementedError):
        manifold.manifold_view(df.selectExpr("tile_id", "embedding anchor", "embedding neighbor"), df.selectExpr("tile_id", "0.0 x", "0.0 y"), "hexagons")
    with pytest.raises(ValueError):
        stats.assert_uniform(df, "tile_id")
    with pytest.raises(NotImplementedError):
        measures.measure_tiles(df, "nothing")
    with pytest.raises(NotImplementedError):
        augment.image_chain(df, "predict", "vgg16")
    with pytest.raises(ValueError):
        tiling.number_tiles(spark.createDataFrame([("s", "s.png", 100, 100)], "scene_id string, filepath string, nx int, ny int"))


def test_constant_component_gives_zero(spark):
    df = vectors(spark, np.array([[1.0, 2.0, 3.0], [1.0, 4.0, 5.0]]))
    rows = rasters.make_rgb(df, [0, 1, 2]).orderBy("tile_id").collect()
    assert [(r["r"], r["g"], r["b"], r["a"]) for r in rows] == [(0.0, 0.0, 0.0, 0.5), (0.0, 1.0, 1.0, 0.5)]


def test_names():
    assert names.parse_kwargs("n_components=4,alpha=0.5") == {"n_components": 4, "alpha": 0.5}
    assert names.transform_name("pca", n_components=4) == "pca_transform__n_components_4"
    assert names.format_fields(names.TRIPLET_NAME) == [("triplet_id", "long"), ("tile_type", "string")]


def test_nearest_tile_many_points(spark, monkeypatch):
    rng = np.random.default_rng(0)
    t, p = rng.uniform(size=(50, 2)), rng.uniform(size=(40, 2))
    tiles = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "tile_id long, x double, y double")
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "point_id long, x double, y double")
    want = (((p[:, None] - t[None]) * [1, 2.0]) ** 2).sum(2).argmin(1)
    for limit in (10_000, 5):
        monkeypatch.setattr(sampling, "BROADCAST_ROWS", limit)
        got = {r["point_id"]: r["tile_id"] for r in sampling.nearest_tile(tiles, pts, 2.0).collect()}
        assert [got[i] for i in range(40)] == want.tolist()


def test_annotate_points_kinds(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(10)], "tile_id long, x double, y double")
    assert sampling.annotate_points(df, 4).count() == 4
    assert [r["tile_id"] for r in sampling.annotate_points(df, [3, 1, 3]).collect()] == [3, 1, 3]
    out = sampling.annotate_points(df, (([2.1], [0.5]), ([1.9], [0.1]))).first()
    assert out["tile_id"] == 2 and out["x_err"] == 0.5
    with pytest.raises(NotImplementedError):
        sampling.annotate_points(df, "all")


def test_windows_stay_inside(spark):
    scenes = spark.createDataFrame([("a", 300, 260), ("b", 200, 400)], "scene_id string, nx int, ny int")
    w = tiling.moving_windows(scenes, (10, 2))
    assert w.filter("scene_id = 'b'").isEmpty()
    tiling.register_sql(spark)
    scenes.createOrReplaceTempView("scenes")
    sql = spark.sql("select s.scene_id, w.i, w.j from scenes s, lateral moving_window(s.nx, s.ny, 256, 256, 10, 2) w")
    assert sorted(map(tuple, sql.collect())) == sorted(tuple(r) for r in w.select("scene_id", "i", "j").collect())
    assert w.count() == 5 * 3 and w.filter("i + 256 > nx or j + 256 > ny").isEmpty()


def test_mask_objects_against_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.uniform(size=(13, 17)) < 0.55
        seen, sizes = np.zeros_like(m), []
        for i, j in zip(*np.nonzero(m)):
            if seen[i, j]:
                continue
            stack, size = [(i, j)], 0
            seen[i, j] = True
            while stack:
                a, b = stack.pop()
                size += 1
                for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= c < 13 and 0 <= d < 17 and m[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
            sizes.append(size)
        assert sorted(measures.mask_objects(m)[0].astype(int)) == sorted(sizes)
    stack = rng.uniform(size=(6, 9, 7)) < 0.5
    for one, part in zip(stack, measures.stacked_objects(stack)):
        for a, b in zip(measures.mask_objects(one), part):
            np.testing.assert_allclose(np.sort(a), np.sort(b))


def test_augmentation_is_seeded(spark):
    img = inputs.images(spark, SF).limit(20)
    run = lambda **k: {r["tile_id"]: r["tensor"] for r in augment.image_chain(img, "train", **k).collect()}
    a, b, c = run(epoch=1), run(epoch=1), run(epoch=2)
    assert a == b and a != c
    plain = augment.image_chain(img, "predict")
    same = augment.augment(plain, p_flip_vertical=0, p_flip_horizontal=0, p_affine=0, p_lighting=0)
    assert {r["tile_id"]: r["tensor"] for r in same.collect()} == {r["tile_id"]: r["tensor"] for r in plain.collect()}
    flip = augment.augment(plain, p_flip_vertical=1, p_flip_horizontal=0, p_affine=0, p_lighting=0)
    x, y = (np.array(d.orderBy("tile_id").first()["tensor"]).reshape(3, 8, 8) for d in (plain, flip))
    np.testing.assert_array_equal(y, x[:, ::-1])


def test_encoder_needs_room():
    with pytest.raises(ValueError):
        embed.block_encoder(8)()(np.zeros((1, 3, 2, 2), dtype=np.float32))


def test_links_in_crowded_cells(spark, monkeypatch):
    from tilequery.operators import knn, trajectories

    rng = np.random.default_rng(4)
    rows = [("p", f, f * 100 + i, float(x), float(y)) for f in range(3) for i, (x, y) in enumerate(rng.uniform(0, 4, (40, 2)))]
    rows += [("p", 1, 900 + i, rows[0][3], rows[0][4]) for i in range(3)]
    df = spark.createDataFrame(rows, "prefix string, frame int, point_id long, x double, y double")
    d = lambda a, b: float(np.hypot(a[3] - b[3], a[4] - b[4]))
    want = set()
    for a in rows:
        near = sorted((d(a, b), b[2], b) for b in rows if b[1] == a[1] + 1 and d(a, b) <= 0.7)
        if near:
            b = near[0][2]
            if min((d(c, b), c[2]) for c in rows if c[1] == a[1])[1] == a[2]:
                want.add((a[1], a[2], b[2]))
    for pairs in (65_536, 4):
        monkeypatch.setattr(knn, "CELL_PAIRS", pairs)
        got = {(r["frame"], r["point_id"], r["next_id"]) for r in trajectories.link_points(df, 0.7).collect()}
        assert got == want


def test_intermediates_are_dropped(spark):
    from pathlib import Path

    from tilequery import session

    df = session.materialize(spark.range(10))
    folder = Path(session._scratch(spark).removeprefix("file:"))
    assert df.count() == 10 and any(folder.iterdir())
    session.drop_intermediates(spark)
    assert not folder.exists()
    with pytest.raises(ValueError):
        session.bounded_rows(spark.range(10), 5, "rows")


def test_null_vectors_and_unknown_options(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i % 5 == 0 else [float(v) for v in rng.normal(size=4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "tile_id long, embedding array<double>")
    for kind, options, result in (
        ("standard_scaler", {}, "emb"), ("pca", {"n_components": 2, "whiten": True}, "emb"), ("kmeans", {"k": 2, "random_state": 3}, "label"),
        ("hdbscan", {"min_cluster_size": 3}, "label"), ("isomap", {"n_neighbors": 4}, "emb"),
    ):
        out, model = transforms.apply_transform(df, kind, **options)
        got = {r["tile_id"]: r[result] for r in out.collect()}
        assert {i for i, v in got.items() if v is None} == set(range(0, 40, 5)) and len(got) == 40, kind
        if kind == "pca":
            assert np.allclose(np.var([v for v in got.values() if v is not None], axis=0, ddof=1), 1)
    assert len(transforms.fit_pca(df, 0.99).components) <= 4
    for kind in ("standard_scaler", "pca", "kmeans", "hdbscan", "pca_hdbscan", "isomap"):
        with pytest.raises(TypeError):
            transforms.apply_transform(df, kind, colour="blue")


def test_longitudes(spark):
    pts = spark.createDataFrame([(float(o), 0.0) for o in range(-180, 180, 10)], "lon double, lat double")
    lons = lambda *e: sorted(r["lon"] for r in geo.in_extent(pts, e, (-1, 1)).collect())
    assert lons(170, -170) == lons(-190, -170) == [-180.0, -170.0, 170.0]
    assert len(lons(-180, 180)) == len(lons(0, 360)) == 36 and lons(0, 20) == [0.0, 10.0, 20.0]
    around = geo.inside_polygon(F.col("lat"), F.col("lon"), [(-5, 165), (5, 165), (5, -165), (-5, -165)])
    assert sorted(r["lon"] for r in pts.filter(around).collect()) == [-180.0, -170.0, 170.0]
    tile = spark.createDataFrame([(1, 0.0, 179.95, 60000.0)], "tile_id long, lat double, lon double, size double")
    field = spark.createDataFrame([(0.0, -179.9), (0.0, 179.9), (0.0, 178.0)], "lat double, lon double")
    assert geo.crop_field(field, tile).count() == 2


def test_uneven_steps_and_missing_labels(spark):
    even = spark.createDataFrame([(1, 0), (1, 50), (1, 100)], "scene_id int, i0 int")
    assert rasters.image_extent(even).first()["i0_max"] == 125
    with pytest.raises(Exception, match="uneven steps"):
        rasters.image_extent(spark.createDataFrame([(1, 0), (1, 50), (1, 175)], "scene_id int, i0 int")).collect()
    labels = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "tile_id int, label string")
    got = {r["tile_id"]: (r["r"], r["g"], r["b"]) for r in rasters.label_colours(labels, background="b").collect()}
    assert got == {0: (1.0, 0.0, 0.0), 1: (1.0, 1.0, 1.0), 2: (1.0, 1.0, 1.0)}
