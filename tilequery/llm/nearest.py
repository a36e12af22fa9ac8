"""Approximate nearest neighbours by collision counting over query-centred windows of sorted projections."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequery.session import materialize

#: vectors of one shard (at most 65,535, places are 16 bits), queries that meet a shard at once
SHARD_ROWS, QUERY_ROWS = 16_384, 4096
PROJECTIONS = 112
#: half a window in units of the search radius: a vector at the radius collides in 82.6 % of the projections
HALF_WINDOW = 1.36
#: share of the projections in which a vector must collide to be verified
THRESHOLD = 0.75
#: growth of the radius per round, share of a shard whose verification ends the search
GROWTH, VERIFIED = 1.15, 0.4


class SortedProjections:
    """One shard: for each random line the sorted places of its vectors, and every vector's rank there.

    Largest inner product becomes nearest distance: vectors are scaled by the longest norm and get one more coordinate that
    makes them unit length; queries are scaled to unit length.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        norms = np.linalg.norm(vectors, axis=1)
        self.longest = norms.max()
        x = vectors / self.longest
        lift = np.sqrt(np.maximum(0.0, 1 - (norms / self.longest) ** 2))
        self.unit = np.concatenate([x, lift[:, None]], 1).astype(np.float32)
        lines = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, PROJECTIONS))
        self.lines = lines.astype(np.float32)
        places = self.unit @ self.lines
        order = np.argsort(places, axis=0, kind="stable")
        self.sorted = np.take_along_axis(places, order, 0).T.copy()
        self.rank = np.empty((PROJECTIONS, len(ids)), np.uint16)
        for p in range(PROJECTIONS):
            self.rank[p, order[:, p]] = np.arange(len(ids), dtype=np.uint16)

    def radius(self, queries: np.ndarray, k: int) -> float:
        """The distance at which a typical query has ``k`` neighbours here, from up to 32 queries."""
        some = queries[:: max(1, len(queries) // 32)][:32]
        d = 2 - 2 * (some @ self.unit.T)
        return float(np.sqrt(np.maximum(1e-8, np.median(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]))))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query id, ids, scores) of the best ``k`` verified vectors of each query, its own id left out."""
        unit = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
        unit = np.concatenate([unit, np.zeros((len(unit), 1), np.float32)], 1)
        places = unit @ self.lines
        n = len(self.ids)
        least = int(np.ceil(THRESHOLD * PROJECTIONS))
        radius = self.radius(unit, k + 1)
        active = np.arange(len(queries))
        while len(active):
            half = HALF_WINDOW * radius + 1e-4
            # the window [low, low + size) of each sorted line around each query
            low, high = np.empty((2, len(active), PROJECTIONS), np.int64)
            for p in range(PROJECTIONS):
                low[:, p], high[:, p] = (np.searchsorted(self.sorted[p], places[active, p] + side) for side in (-half, half))
            wide = high > low
            low, size = low.astype(np.uint16), (high - low - 1).astype(np.uint16)
            later = []
            for i, q in enumerate(active.tolist()):
                count = np.zeros(n, np.uint8)
                for p in np.flatnonzero(wide[i]).tolist():
                    count += (self.rank[p] - low[i, p]) <= size[i, p]  # unsigned differences wrap
                found = np.flatnonzero(count >= least)
                near = self.unit[found] @ unit[q] if len(found) else np.zeros(0, np.float32)
                full = len(found) == n or radius > 4
                if len(found) >= min(n, k + 1):
                    kth = np.partition(near, len(near) - min(n, k + 1))[len(near) - min(n, k + 1)]
                    full |= bool(2 - 2 * kth <= radius * radius) or len(found) >= VERIFIED * n
                if not full:
                    later.append(q)
                    continue
                if len(found) > k + 1:  # float errors are far below this margin
                    cut = np.partition(near, len(near) - k - 1)[len(near) - k - 1] - 1e-4
                    found = found[near >= cut]
                found = found[self.ids[found] != query_ids[q]]
                score = (self.vectors[found] * queries[q]).sum(1)
                best = np.lexsort((self.ids[found], -score))[:k]
                yield query_ids[q], self.ids[found[best]], score[best]
            active = np.array(later, np.int64)
            radius *= GROWTH


def usable(vector: str) -> Column:
    """Neither null, empty nor zero, without null or non-finite components."""
    v = F.col(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, id_: str, vector: str, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors found with the largest inner product for each query.

    Queries are the rows of ``vectors`` where ``is_query`` holds, candidates all rows but the query's own. Scores are exact, in
    double precision on the vectors as given; ties go to the smaller id. Rows without id and vectors
    that are not :func:`usable` take no part; only vectors of one length are compared. Rows that share an id are never
    each other's neighbours; a repeated query row gives one answer. Fewer than ``k`` candidates: all of them.

    Shards of ``SHARD_ROWS`` vectors meet the queries in blocks of ``QUERY_ROWS``; each shard answers with its best, which are ranked per query.
    """
    rows = vectors.filter(usable(vector) & F.col(id_).isNotNull()).select(
        F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    rows = materialize(rows)
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, groups = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_q // QUERY_ROWS))
    # a little more shards than needed, so that chance does not overfill one
    shards = shards if shards == 1 else -(-5 * shards // 4)
    place = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    data = rows.select("id", "v", "dims", place(1, shards).alias("shard")).withColumn("block", every(groups))
    queries = rows.filter("q").dropDuplicates(["id", "dims"]).select("id", "v", "dims", place(2, groups).alias("block")).withColumn("shard", every(shards))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            whole, asked = (t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
            ids = left.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            for at in range(0, len(ids), 60_000):
                part = order[at : at + 60_000]
                index = SortedProjections(ids[part], whole[part])
                for q, found, score in index.search(right.column("id").to_numpy(), asked, k):
                    out[0] += [q] * len(found)
                    out[1] += found.tolist()
                    out[2] += score.tolist()
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    keys = ["shard", "block", "dims"]
    found = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
