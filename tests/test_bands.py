"""Scenes in bands: crops against slices, batches across bands, bytes that the shuffles move."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequery.operators import embed, tiling


def scenes(spark, shapes, seed=2):
    rng = np.random.default_rng(seed)
    images = {f"s{n}": rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for n, (h, w) in enumerate(shapes)}
    rows = [(k, v.shape[0], v.shape[1], bytearray(v.tobytes())) for k, v in images.items()]
    return images, spark.createDataFrame(rows, "scene_id string, h int, w int, pixels binary")


def shuffled_bytes(spark, job) -> int:
    """Bytes that the shuffles of ``job()`` wrote."""
    sc = spark.sparkContext
    group = f"bands-{np.random.randint(1 << 30)}"
    sc.setJobGroup(group, group)
    job()
    sc.setJobGroup("", "")
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages)


@pytest.mark.parametrize("step,tile", [((3, 2), (8, 9)), ((8, 9), (8, 9)), ((11, 13), (8, 9)), ((1, 1), (20, 20))])
@pytest.mark.parametrize("most", [64 << 20, 2000])
def test_every_window_once(spark, monkeypatch, step, tile, most):
    monkeypatch.setattr(tiling, "BAND_BYTES", most)
    images, df = scenes(spark, [(40, 31), (20, 20), (9, 8), (8, 40), (40, 7)])
    got = {(r.scene_id, r.j, r.i): bytes(r.pixels) for r in tiling.crop_scenes(df, step, tile).collect()}
    want = {
        (k, j, i): v[j : j + tile[1], i : i + tile[0]].tobytes()
        for k, v in images.items()
        for j in range(0, v.shape[0] - tile[1] + 1, step[1])
        for i in range(0, v.shape[1] - tile[0] + 1, step[0])
    }
    assert got == want
    assert tiling.crop_scenes(df, step, tile).count() == len(want)


def test_batches_go_on_across_bands(spark):
    images, df = scenes(spark, [(61, 24), (33, 24)])

    def make():
        return lambda x: np.stack([np.full(len(x), len(x)), x.mean((1, 2, 3))], 1)

    df = df.coalesce(1)
    rows = embed.embed_scenes(df, make, (4, 4), (16, 16), batch_size=7, spread=False).collect()
    n = sum(((v.shape[0] - 16) // 4 + 1) * 3 for v in images.values())
    assert len(rows) == n and len({(r.scene_id, r.i, r.j) for r in rows}) == n
    assert sum(r.embedding[0] != 7 for r in rows) == n % 7
    for r in rows:
        assert r.embedding[1] == pytest.approx(images[r.scene_id][r.j : r.j + 16, r.i : r.i + 16].mean() / 255, abs=1e-5)
    assert embed.embed_scenes(df.limit(0), make, (4, 4), (16, 16)).count() == 0


def test_bands_shuffle_little_more_than_the_scene(spark):
    _, df = scenes(spark, [(2400, 300)])
    size = 2400 * 300 * 3
    bands = tiling.scene_bands(df, (10, 10), (256, 256))
    assert bands.count() > 1
    assert size < shuffled_bytes(spark, lambda: bands.select(F.sum(F.crc32("band"))).collect()) < 1.5 * size


def test_points_meet_bands(spark):
    images, df = scenes(spark, [(900, 60), (64, 64), (40, 40)])
    rng = np.random.default_rng(5)
    points = [(n, f"s{n % 3}", int(rng.integers(0, 60)), int(rng.integers(0, 900 if n % 3 == 0 else 64))) for n in range(300)]
    points += [(300, "s0", 30, 8), (301, "s0", 30, 892), (302, "s0", 30, 72), (303, "none", 3, 3)]
    pts = spark.createDataFrame(points, "p int, scene_id string, i int, j int")
    size = df.select("scene_id", F.col("w").alias("nx"), F.col("h").alias("ny"))
    windows = tiling.centred_windows(pts.join(size, "scene_id", "left"), (16, 16))
    valid = {r.p: r for r in windows.filter("valid").collect()}
    got = tiling.crop_points(windows, df, (16, 16)).collect()
    assert sorted(r.p for r in got) == sorted(valid) and {300, 301, 302} <= set(valid)
    for r in got:
        v = valid[r.p]
        assert bytes(r.pixels) == images[r.scene_id][v.j_start : v.j_start + 16, v.i_start : v.i_start + 16].tobytes()


def test_points_shuffle_the_scene_once(spark):
    _, df = scenes(spark, [(2000, 300)])
    size = 2000 * 300 * 3
    pts = spark.range(500).selectExpr("id", "'s0' as scene_id", "cast(20 + id % 250 as int) as i", "cast(20 + id * 3 as int) as j", "300 as nx", "2000 as ny")
    windows = tiling.centred_windows(pts, (16, 16))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = shuffled_bytes(spark, lambda: tiling.crop_points(windows, df, (16, 16)).select(F.sum(F.crc32("pixels"))).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert size < moved < 1.35 * size
