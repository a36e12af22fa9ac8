"""Larger or odder tables than the given ones, for queries that failed on them."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from check import compare
from conftest import vectors
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilequery.operators import graph, knn, linkage, trajectories
from tilequery.streaming import scenes

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def same_as_sql(spark, root, name, **tables) -> str | None:
    """What differs between a query and its SQL over tables of the test's own."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{root}/{table}.parquet/*.parquet'")
    try:
        return compare(spark, con, QUERIES[name], SQL[name], str(root))
    finally:
        con.close()


def embeddings(spark, x: np.ndarray, label=lambda i: 0):
    rows = [(i, [float(v) for v in r], label(i)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def tall(spark):
    """One scene of more tiles than 3,200 pixel rows hold, one of fewer."""
    return embeddings(spark, np.random.default_rng(3).normal(size=(700, 4)), lambda i: int(i % 5 == 0))


def test_coordinates_of_tall_scenes(spark, tmp_path, tall):
    assert same_as_sql(spark, tmp_path, "tile_coordinates", embeddings=tall) is None


def test_order_of_tiles_in_tall_scenes(spark, tmp_path, tall):
    assert same_as_sql(spark, tmp_path, "tiles_in_order", embeddings=tall) is None


def test_groups_of_cells(spark, monkeypatch):
    """Pivots and their groups, rows compared in small tiles, several blocks of both sides: the same neighbours."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 3)) + 6 * rng.normal(size=3) for _ in range(4)])
    x[7] = x[9] = x[11]
    for name, value in (("BLOCK", 20), ("PLAIN_BLOCKS", 0), ("LEFT_TILE", 7), ("RIGHT_TILE", 13)):
        monkeypatch.setattr(knn, name, value)
    df = vectors(spark, x)
    got = {}
    for r in knn.knn_join(df, df, 4).collect():
        got.setdefault(r["tile_id"], []).append((r["rank"], r["neighbor_id"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        want = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in want]


def test_what_blocks_send_grows_like_the_rows():
    """Every row goes to a fixed number of blocks as long as a block may hold its share of the table."""
    for n in (10_000, 120_000, 700_000):
        a, b = knn.block_cuts(n, n, 64, 12)
        assert a + b <= 16 and a * b >= 48
    a, b = knn.block_cuts(10_000_000, 10_000_000, 64, 12)
    assert 10_000_000 / a * 64 * 8 <= 1.01 * knn.BLOCK_BYTES >= 10_000_000 / b * 64 * 8 / 1.01


def test_spanning_tree_lists(spark, monkeypatch):
    """Short lists run out and are searched anew; copies and separate starting parts too."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(25, 2)), rng.normal(size=(15, 2)) + 9, np.repeat(rng.normal(size=(2, 2)), 6, axis=0)])
    monkeypatch.setattr(graph, "LISTED", 2)
    monkeypatch.setattr(graph, "MANY", 8)
    tree = graph.spanning_tree(vectors(spark, x).select(F.col("tile_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0.0).alias("w")))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edges, up = [], list(range(len(x)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for w, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
        if top(i) != top(j):
            up[top(i)] = top(j)
            edges.append((i, j, round(w, 9)))
    assert sorted((r["u"], r["v"], round(r["weight"], 9)) for r in tree.collect()) == sorted(edges)


@pytest.mark.parametrize("method", ["complete", "average"])
def test_linkage_of_cut_clusters(spark, monkeypatch, method):
    """Clusters larger than a piece, and copies, give the heights of one-by-one merging."""
    monkeypatch.setattr(linkage, "TAIL", 4)
    monkeypatch.setattr(linkage, "PIECE_ROWS", 5)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(22, 3)), rng.normal(size=(8, 3)) + 5])
    x[3] = x[4] = x[5]
    parts, want = {i: [i] for i in range(len(x))}, []
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    fold = np.max if method == "complete" else np.mean
    while len(parts) > 1:
        h, i, j = min((fold(d[np.ix_(parts[i], parts[j])]), i, j) for i in parts for j in parts if i < j)
        parts[i] += parts.pop(j)
        want.append((round(h, 9), len(parts[i])))
    got = sorted((r["height"], r["size"]) for r in linkage.linkage(vectors(spark, x), method).collect())
    assert [n for _, n in got] == [n for _, n in sorted(want)]
    np.testing.assert_allclose([h for h, _ in got], [h for h, _ in sorted(want)], atol=2e-9)


def test_points_of_crowded_frames(spark, monkeypatch):
    """Links are the same when points are looked for from short distances on."""
    monkeypatch.setattr(knn, "PAIRS_EACH", 1)
    monkeypatch.setattr(knn, "BLOCK", 1)
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.uniform(0, 40, (90, 2)), rng.normal(5, 0.2, (60, 2))])
    rows = [("p", int(i % 2), i, float(x), float(y)) for i, (x, y) in enumerate(at)]
    points = spark.createDataFrame(rows, "prefix string, frame long, point_id long, x double, y double")
    a, b = ([r for r in rows if r[1] == f] for f in (0, 1))
    gap = {(p[2], q[2]): float(np.hypot(p[3] - q[3], p[4] - q[4])) for p in a for q in b}
    fwd = {p[2]: min((gap[p[2], q[2]], q[2]) for q in b) for p in a}
    back = {q[2]: min((gap[p[2], q[2]], p[2]) for p in a) for q in b}
    want = {(i, j) for i, (d, j) in fwd.items() if d <= 10 and back[j][1] == i}
    steps = []
    real = knn._nearest_at
    monkeypatch.setattr(knn, "_nearest_at", lambda *args: steps.append(args[-1]) or real(*args))
    assert {(r["point_id"], r["next_id"]) for r in trajectories.link_points(points, 10.0).collect()} == want
    assert len(steps) > 4 and min(steps) < 5


def test_streamed_scenes_in_few_folders(spark, tmp_path):
    """Scenes do not get a folder each."""
    rows = [(i, 6, 6, bytes([i]) * 108) for i in range(200)]
    spark.createDataFrame(rows, "scene_id long, h int, w int, pixels binary").write.parquet(str(tmp_path / "in"))
    means = lambda: lambda x: x.reshape(len(x), -1).mean(1, keepdims=True)
    stream = scenes.scene_stream(spark, str(tmp_path / "in"), "parquet")
    scenes.stream_scenes(stream, means, str(tmp_path / "out"), str(tmp_path / "state"), (3, 3), (6, 6)).awaitTermination()
    files = list((tmp_path / "out").glob("*/*.parquet"))
    assert 0 < len(files) <= scenes.SCENE_PARTS
    got = {r["scene_id"]: r["embedding"][0] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 200 and all(abs(v - i / 255) < 1e-6 for i, v in got.items())
