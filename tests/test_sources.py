"""Catalogues, pictures, metadata files, sinks and the scene stream."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from conftest import png
from pyspark.sql import functions as F

from tilequery.functions import pixels
from tilequery.operators import embed, geo, tiling, transforms, triplets
from tilequery.sources import catalog, images, sinks, tables
from tilequery.streaming.scenes import scene_stream, stream_scenes


def test_scan_and_triplets(spark, tile_dir):
    tiles = catalog.scan_tiles(spark, str(tile_dir), stage="train")
    assert tiles.count() == 36 and "content" not in tiles.columns
    assert tiles.filter("triplet_id = 3").select("tile_type").distinct().count() == 3
    wide = triplets.triplets(tiles)
    assert wide.count() == 12
    gap = tiles.filter("filepath <> '00002_distant.png'")
    with pytest.raises(ValueError):
        triplets.triplets(gap)
    assert triplets.triplets(gap, "skip").count() == 11
    with pytest.raises(ValueError):
        triplets.singlets(tiles, None)
    with pytest.raises(FileNotFoundError):
        triplets.singlets(tiles, "anchor", lambda t: t.filter("tile_id > 100"))
    stages = catalog.scan_stages(spark, str(tile_dir))
    assert [r[0] for r in stages.select("stage").distinct().collect()] == ["train"]
    assert [r[0] for r in catalog.list_dirs(spark, str(tile_dir)).collect()] == ["train"]


def test_sidecar_modes(spark, tile_dir):
    tiles = catalog.scan_tiles(spark, str(tile_dir / "train"))
    side = spark.createDataFrame([("00000_anchor.png", 1.5)], "filepath string, cloud double")
    assert catalog.attach_sidecar(tiles, side).filter("cloud = 1.5").count() == 1
    assert catalog.attach_sidecar(tiles, side, False).columns == tiles.columns
    with pytest.raises(FileNotFoundError):
        catalog.attach_sidecar(tiles, side, True)
    aux = catalog.with_aux(tiles, lambda p: {"n": len(p)}, "n int")
    assert aux.filter("filepath = '00000_anchor.png'").first()["n"] == 16


def test_catalogue_cache(spark, tile_dir, tmp_path):
    cache = str(tmp_path / "cache")
    path = str(tile_dir / "train")
    first = catalog.cached_catalog(spark, path, cache)
    assert first.count() == 36
    # a cached row more does not matter, a missing one rebuilds
    first.filter("triplet_id < 5").write.mode("overwrite").parquet(str(tmp_path / "stale"))
    assert catalog.cached_catalog(spark, path, str(tmp_path / "stale")).count() == 36
    extra = spark.createDataFrame([("99999_anchor.png", 99999, "anchor")], "filepath string, triplet_id long, tile_type string")
    first.unionByName(extra).write.parquet(str(tmp_path / "more"))
    assert catalog.cached_catalog(spark, path, str(tmp_path / "more")).count() == 37
    assert catalog.cached_catalog(spark, path, str(tmp_path / "more"), overwrite=True).count() == 36


def test_integrity(spark, tile_dir):
    good = hashlib.md5((tile_dir / "train" / "00000_anchor.png").read_bytes()).hexdigest()
    want = [("00000_anchor.png", good), ("00001_anchor.png", "0" * 32), ("nope.png", good), ("00002_anchor.png", None)]
    out = catalog.verify_files(spark, str(tile_dir / "train"), spark.createDataFrame(want, "name string, md5 string"), ".png")
    assert {r["name"]: r["status"] for r in out.collect()} == {
        "00000_anchor.png": "ok", "00001_anchor.png": "changed", "nope.png": "missing", "00002_anchor.png": "ok",
    }


def test_pictures(spark, tile_dir, tmp_path):
    path = str(tile_dir / "train")
    tiles = images.load_tiles(spark, path, catalog.scan_tiles(spark, path))
    assert tiles.count() == 36
    src = np.zeros((2, 3, 3), dtype=np.uint8)
    src[0, 0] = (10, 20, 30)
    folder = tmp_path / "one"
    folder.mkdir()
    png(folder / "a.png", src)
    px = images.load_images(spark, str(folder)).first()
    assert (px["h"], px["w"]) == (2, 3) and bytes(px["pixels"])[:3] == bytes([10, 20, 30])
    blank = tiles.select("filepath", pixels.is_blank().alias("b")).filter("b")
    assert [r[0] for r in blank.collect()] == ["00003_anchor.png"]
    tensor = images.load_images(spark, str(folder)).select(pixels.unit_tensor().alias("t")).first()["t"]
    assert tensor[0] == pytest.approx(10 / 255) and tensor[6] == pytest.approx(20 / 255)
    cached = images.cache_images(tiles, str(tmp_path / "px"))
    assert cached.count() == 36
    (folder / "bad.png").write_bytes(b"no picture")
    # a truncated picture keeps its row unless asked otherwise
    kept = {r["filepath"]: r["pixels"] for r in images.load_images(spark, str(folder)).collect()}
    assert len(kept) == 2 and sum(v is None for v in kept.values()) == 1
    assert images.load_images(spark, str(folder), drop_invalid=True).count() == 1


def test_tile_definitions_and_domain(spark, tile_dir, tmp_path):
    a = tables.tile_definitions(spark, str(tile_dir / "train"), "anchor").orderBy("tile_id").first()
    assert (a["lat"], a["lon"], a["source_files"]) == (10.5, -50.0, ["a0.nc"])
    d = tables.tile_definitions(spark, str(tile_dir / "train"), "distant").orderBy("tile_id").first()
    assert d["lat"] == 15.5 and d["source_files"] == ["b0.nc", "c0.nc"]
    (tmp_path / "d.yaml").write_text("- - 56.0\n  - 282.4\n- - 42.1\n  - 280.3\n- - 41.6\n  - 331.2\n- - 56.7\n  - 332.3\n")
    domain = tables.read_domain(spark, str(tmp_path / "d.yaml"))
    pts = spark.createDataFrame([(1, 50.0, -60.0), (2, 50.0, 300.0), (3, 20.0, -60.0)], "k int, lat double, lon double")
    assert sorted(r["k"] for r in geo.in_domain(pts, domain).collect()) == [1, 2]


def test_sinks(spark, tile_dir, tmp_path):
    emb = spark.createDataFrame([(i, "anchor", "train", "d", [float(i), 1.0], i % 3) for i in range(20)],
                                "tile_id long, tile_type string, stage string, data_dir string, embedding array<float>, scene_id long")
    out = str(tmp_path / "emb")
    sinks.write_embeddings(emb, out)
    back = spark.read.parquet(out)
    assert back.count() == 20 and "PartitionFilters: [isnotnull(scene_id" in back.filter("scene_id = 1")._jdf.queryExecution().toString()
    sinks.write_embeddings(emb.drop("scene_id"), str(tmp_path / "flat"), partition=None)
    assert tables.read_embeddings(spark, str(tmp_path / "flat"), "train").count() == 20
    sinks.export_projector(emb, str(tmp_path / "proj"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "proj" / "vectors.tsv")).collect()]
    assert "3.0\t1.0" in lines and len(lines) == 20
    sinks.write_catalog_csv(emb.select("tile_id", "stage"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["tile_id", "stage"]
    sinks.write_clusters(emb.select("tile_id", F.lit(0).alias("cluster_id")), str(tmp_path / "cl"))
    crops = emb.select(F.lit("s").alias("scene_id"), F.col("tile_id").alias("i0"), F.lit(7).alias("j0"), F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(b"abc").alias("pixels"))
    sinks.write_crops(crops, str(tmp_path / "crops"))
    assert spark.read.parquet(str(tmp_path / "crops")).filter("name = '00003_00007.png'").count() == 1


def test_models_are_stored_by_name(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(30)], "tile_id long, embedding array<double>")
    for kind in ("pca", "standard_scaler", "kmeans"):
        kw = {"n_components": 2} if kind == "pca" else {"k": 3} if kind == "kmeans" else {}
        out, model = transforms.apply_transform(df, kind, **kw)
        sinks.save_model(model, str(tmp_path / "models" / kind))
        again, _ = transforms.apply_transform(df, kind, sinks.load_model(spark, str(tmp_path / "models"), kind))
        col = "label" if kind == "kmeans" else "emb"
        assert [r[0] for r in out.orderBy("tile_id").select(col).collect()] == [r[0] for r in again.orderBy("tile_id").select(col).collect()]
    with pytest.raises(FileNotFoundError, match="pca"):
        sinks.load_model(spark, str(tmp_path / "models"), "unknown")


def test_scene_stream_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    src, out, state = (tmp_path / n for n in ("in", "out", "state"))
    src.mkdir()

    def means():
        return lambda x: x.reshape(x.shape[0], 3, -1).mean(axis=2)

    for n in range(2):
        png(src / f"goes__{n}.png", rng.integers(0, 256, (40, 60, 3)))

    def run():
        q = stream_scenes(scene_stream(spark, str(src)), means, str(out), str(state), step=(10, 10), tile=(20, 20))
        q.awaitTermination()
        return spark.read.parquet(str(out))

    assert run().count() == 2 * 5 * 3
    png(src / "goes__2.png", rng.integers(0, 256, (40, 60, 3)))
    got = run()
    assert got.count() == 3 * 5 * 3 and got.select("scene_id").distinct().count() == 3
    scenes = images.scan_scenes(spark, str(src))
    assert scenes.select("nx", "ny").distinct().collect()[0] == (60, 40)
    assert tiling.number_tiles(scenes, (10, 10), (20, 20)).agg(F.max("tile_id")).first()[0] == 44
    png(src / "odd.png", rng.integers(0, 256, (10, 10, 3)))
    with pytest.raises(ValueError):
        images.scan_scenes(spark, str(src))


def test_embedding_is_repeatable(spark, tile_dir):
    path = str(tile_dir / "train")
    tiles = images.load_tiles(spark, path, catalog.scan_tiles(spark, path))
    runs = [embed.embed(tiles, embed.block_encoder(100), b).select("triplet_id", "tile_type", "embedding") for b in (32, 5)]
    a, b = ({(r[0], r[1]): r[2] for r in d.collect()} for d in runs)
    assert len(a) == 36 and len(a[(0, "anchor")]) == 100
    for k in a:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-5)
