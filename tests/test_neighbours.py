"""Neighbours from hashed buckets, and tables laid out in order."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import vectors
from pyspark.sql import functions as F

from tilequery.operators import knn, select
from tilequery.sources import catalog


@pytest.mark.parametrize("n,options", [(400, {"bits": 4, "tables": 6, "probes": 6}), (60, {}), (40, {"bits": 9, "tables": 1, "probes": 1})])
def test_hashed_neighbours(spark, n, options):
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(size=(n // 4, 8)) + 4 * rng.normal(size=8) for _ in range(4)])
    x[5] = x[6] = x[7]  # copies
    df = vectors(spark, x)
    got = {}
    for r in knn.knn_join(df, df, 5, method="lsh", **options).collect():
        got.setdefault(r["tile_id"], []).append((r["rank"], r["neighbor_id"], r["dist"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    hit = 0
    for i in range(len(x)):
        rows = sorted(got[i])
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5] and len({j for _, j, _ in rows}) == 5 and i not in {j for _, j, _ in rows}
        assert all(dist == pytest.approx(d[i, j], abs=1e-9) for _, j, dist in rows) and [t for _, _, t in rows] == sorted(t for _, _, t in rows)
        best = np.sort(np.delete(d[i], i))[4]
        hit += sum(t <= best + 1e-9 for _, _, t in rows)
    assert hit >= 0.9 * 5 * len(x)


def test_options_of_neighbours(spark):
    df = vectors(spark, np.eye(4))
    with pytest.raises(ValueError):
        knn.knn_join(df, df, 1, method="tree")
    with pytest.raises(TypeError):
        knn.knn_join(df, df, 1, tables=3)
    assert knn.knn_join(df, df, 10, method="lsh").count() == 12  # fewer than asked for: all of them
    assert knn.knn_join(df.limit(0), df, 2, method="lsh").count() == 0 == knn.knn_join(df, df.limit(0), 2, method="lsh").count()


def test_probe_masks():
    """The probed buckets are those with the smallest sums of squared distances to the planes that lie between."""
    margin = np.random.default_rng(1).normal(size=(7, 3, 5))
    masks = knn._probe_masks(margin, 8)
    for i in range(7):
        for t in range(3):
            cost = sorted((sum(margin[i, t, b] ** 2 for b in range(5) if s >> b & 1), s) for s in range(32))
            assert [s for _, s in cost[:8]] == masks[i, t].tolist()


def test_order_survives_a_write(spark, tmp_path):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(int(s), float(x), float(y), i) for i, (s, x, y) in enumerate(rng.integers(0, 6, (500, 3)))], "scene_id long, x double, y double, tile_id long").repartition(7)
    out = select.tiles_in_order(df)
    out.write.parquet(str(tmp_path / "t"))
    rows = []
    for f in sorted((tmp_path / "t").glob("part-*")):  # file after file, as they lie
        rows += [tuple(r) for r in spark.read.parquet(str(f)).coalesce(1).select("scene_id", "x", "y", "tile_id", "place").collect()]
    assert [r[:4] for r in rows] == sorted(r[:4] for r in rows) and [r[4] for r in rows] == list(range(500))


def test_files_in_order(spark, tile_dir):
    names = [r["name"] for r in catalog.files_in_order(catalog.list_files(spark, f"{tile_dir}/train", ".png")).orderBy("place").collect()]
    assert names == sorted(p.name for p in (tile_dir / "train").glob("*.png"))
    tiles = catalog.files_in_order(catalog.scan_tiles(spark, str(tile_dir), stage="train"), "filepath")
    assert [r["filepath"] for r in tiles.orderBy("place").collect()] == sorted(p.name for p in (tile_dir / "train").glob("*_*.png"))
    assert tiles.filter(F.col("place") < 3).count() == 3
