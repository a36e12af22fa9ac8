"""Near copies by SetSketch registers: banding, joint likelihood estimate, exact check on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.components import components
from tilequery.llm.text import Words, as_long, blocks, mix, shingle_hashes
from tilequery.session import materialize

REGISTERS = 64
BASE = 1.001
RATE = 20.0
#: smallest shingle hashes kept of each set for comparisons inside a bucket
LOWEST = 256
#: members of a bucket compared with each other in one block
BLOCK_MEMBERS = 512
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); empty without words."""
    words = Words(texts, lower=True)
    h, many = shingle_hashes(words.hashes(), words.counts(), width)
    at = np.concatenate([[0], np.cumsum(many)])
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers, one row per set that is not empty.

    Register i is ``floor(1 - log_b(x))`` of the least exponential variate x (rate a) that any element draws for i, truncated to
    16 bits; the register of a union is the larger of two registers.
    """
    x = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        v = x ^ seed
        v *= np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xC4CEB9FE1A85EC53)
        least[:, i] = np.minimum.reduceat(v, at)
    u = ((least >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16)


def likely(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets with known sizes, from how many registers are equal, larger and smaller."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _lowest(s: np.ndarray) -> bytes:
    """The upper halves of the ``LOWEST`` smallest hashes of a sorted set."""
    return (s[:LOWEST] >> np.uint64(32)).astype(np.uint32).tobytes()


def shared_low(low: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of lowest-hash arrays: how many values both have, and how many either has up to where both are complete."""
    top = np.array([a[-1] if len(a) == LOWEST else 0xFFFFFFFF for a in low], np.uint32)
    if len(i) < 200:
        both = np.array([len(np.intersect1d(low[a], low[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:  # all pairs of the block at once: incidence matrix times its transpose
        rows, left = np.unique(i, return_inverse=True)
        cols, right = np.unique(j, return_inverse=True)
        values, at = np.unique(np.concatenate(low), return_inverse=True)
        owner = np.repeat(np.arange(len(low)), [len(a) for a in low])
        has = np.zeros((len(low), len(values)), np.float32)
        has[owner, at] = 1
        both = (has[rows] @ has[cols].T)[left, right].round().astype(np.int64)
    end = np.minimum(top[i], top[j])
    n = [np.array([np.searchsorted(low[a], e, "right") for a, e in zip(x, end)], np.int64) for x in (i, j)]
    return both, n[0] + n[1] - both


def _band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """Hash of every run of ``rows`` registers, [sets, bands]; the band's number is part of it."""
    bands = REGISTERS // rows
    out = np.empty((len(regs), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(regs), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + regs[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


class _Plan:
    """Bands and the least estimate that is checked, from the least similarity in percent.

    With 64 registers a pair at the threshold misses every band once in 10^5 or rarer, and its estimate
    lies 4.5 standard errors or more below the truth as rarely.
    """

    def __init__(self, percent: int):
        self.percent = percent
        s = percent / 100
        self.rows = next((r for r in (4, 3, 2) if (1 - s**r) ** (REGISTERS // r) < 2e-5), 1)
        self.floor = s - 4.5 * math.sqrt(s * (1 - s) / REGISTERS)

    def passes(self, ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        ok = np.minimum(na, nb) * 100 >= self.percent * np.maximum(na, nb)
        equal = (ra == rb).sum(1)
        ok &= equal >= REGISTERS * (self.floor - 0.05)
        at = np.flatnonzero(ok)
        if len(at):
            more = (ra[at] > rb[at]).sum(1)
            est = likely(equal[at], more, REGISTERS - equal[at] - more, na[at].astype(float), nb[at].astype(float))
            ok[at] = est >= self.floor
        return ok

    def passes_low(self, low: list[np.ndarray], whole: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for pairs inside a bucket from their lowest hashes: exact where both sets are wholly kept, else 4.5 standard errors below."""
        both, either = shared_low(low, i, j)
        s = self.percent / 100
        exact = whole[i] & whole[j]
        return np.where(exact, 100 * both >= self.percent * either, both >= (s - 4.5 * math.sqrt(s * (1 - s) / LOWEST)) * either)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, regs, low`` of every row: set size, 128-bit digest of the set, registers and lowest hashes (null for an empty set)."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"), width)
                full = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets], np.int64)
                d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                regs: list = [None] * len(sets)
                low = [_lowest(x) if len(x) else None for x in sets]
                if full:
                    rows, where = registers(full), np.flatnonzero(n)
                    d1[where] = [s.sum(dtype=np.uint64) for s in full]
                    d2[where] = [mix(s + np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64) for s in full]
                    for i, r in zip(where, rows):
                        regs[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), as_long(d1), as_long(d2), pa.array(regs, pa.binary()), pa.array(low, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "regs", "low"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, regs binary, low binary")


def _explode_bands(reps: DataFrame, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _band_keys(_regs(batch.column("regs")), rows)
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([as_long(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["bucket", "id"])

    return reps.select("id", "regs").mapInArrow(run, "bucket long, id long")


def _estimated(pairs: DataFrame, reps: DataFrame, plan: _Plan) -> DataFrame:
    """Pairs whose estimate from the registers reaches the floor."""
    sides = [reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}")) for x in "ab"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(f"n_{x}").to_numpy(zero_copy_only=False) for x in "ab"]
                ok = plan.passes(_regs(batch.column("r_a")), _regs(batch.column("r_b")), *n)
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(ok)) for x in "ab"], ["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have ``100 * intersection >= percent * union``."""

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            n = batch.num_rows
            step = 64
            for at in range(0, n, step):
                part = batch.slice(at, step)
                ids = [part.column(x).to_pylist() for x in "ab"]
                other = shingle_sets(part.column("t_b"), width)
                ok = []
                for i, a in enumerate(ids[0]):
                    text = part.column("t_a")[i].as_py()
                    if last[0] != text:
                        last = (text, shingle_sets(pa.array([text], pa.string()), width)[0])
                    both = len(np.intersect1d(last[1], other[i], assume_unique=True))
                    ok.append(100 * both >= percent * (len(last[1]) + len(other[i]) - both))
                yield pa.RecordBatch.from_arrays([part.column(x).filter(pa.array(ok, pa.bool_())) for x in "ab"], ["a", "b"])

    sides = [texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _between_parts(buckets: DataFrame, reps: DataFrame, plan: _Plan) -> DataFrame:
    """Pairs of a bucket that lie in different components and pass the estimate, found block by block.

    ``buckets``: bucket, id, head, part. A bucket is cut into blocks of about ``BLOCK_MEMBERS`` by a hash of the id and each pair of
    blocks compared as matrices; pairs with the bucket's head were tried before, and a pair that meets in an
    earlier band is left to that band.
    """
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("part").alias("_lo"), F.max("part").alias("_hi"))
    mixed = sizes.filter("_lo != _hi").select("bucket", F.ceil(F.col("_n") / BLOCK_MEMBERS).cast("int").alias("_k"))
    rows = buckets.join(mixed, "bucket").withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    # block x takes part in the pairs (x, y) and (y, x)
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    rows = rows.select(
        "bucket", "id", "head", "part", "_mine", F.least("_mine", "_other").alias("lo"), F.greatest("_mine", "_other").alias("hi")
    ).join(reps.select("id", "n", "regs", "low"), "id")

    def compare(g: dict):
        keys, regs = _band_keys(g["regs"], plan.rows), g["regs"]
        band = np.flatnonzero(keys[0] == np.uint64(g["bucket"] & 0xFFFFFFFFFFFFFFFF))[0]
        pairs: list[tuple[int, np.ndarray]] = []
        for i in np.flatnonzero((g["mine"] == g["lo"]) & (g["id"] != g["head"])).tolist():
            j = np.flatnonzero((g["part"] != g["part"][i]) & (g["id"] != g["id"][i]) & (g["id"] != g["head"]))
            j = j[g["id"][j] > g["id"][i]] if g["lo"] == g["hi"] else j[g["mine"][j] == g["hi"]]
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            if len(j):
                j = j[plan.passes(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), g["n"][i]), g["n"][j])]
            if len(j):
                pairs.append((i, j))
        if not pairs:
            return np.zeros((2, 0), np.int64)
        i, j = np.repeat([p[0] for p in pairs], [len(p[1]) for p in pairs]), np.concatenate([p[1] for p in pairs])
        whole = np.array([len(a) == n and len(np.unique(a)) == n for a, n in zip(g["low"], g["n"])])
        ok = plan.passes_low(g["low"], whole, i, j)
        a, b = g["id"][i[ok]], g["id"][j[ok]]
        return np.stack([np.minimum(a, b), np.maximum(a, b)])

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: t.column(c).to_numpy()
            g = {"bucket": now[0], "lo": now[1], "hi": now[2], "head": t.column("head")[0].as_py(), "id": col("id"), "part": col("part"), "mine": col("_mine"), "n": col("n"), "regs": _regs(t.column("regs"))}
            g["low"] = [np.frombuffer(x, np.uint32) for x in t.column("low").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in compare(g)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = tuple(key[a].tolist())
                if k != now and held:
                    yield close()
                    held = []
                now = k
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    sorted_ = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return sorted_.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (doc_id, text; more columns are ignored).

    Texts are linked when ``100 * |A and B| >= percent * |A or B|`` over their sets of ``width``-word shingles (A-Z lower-cased;
    fewer words: the whole sequence is the one shingle). ``component_id`` is the smallest doc_id
    reachable over links, ``kept`` marks it.

    Equal sets are one class and go on as their smallest doc_id. Classes that share a band of registers are candidates: each is
    tried against the first of its bucket, then members of one bucket that are still in different components are tried
    against each other, so pairs inside a component are never listed. A trial is the likelihood estimate from the registers
    and, above its floor, the exact check.

    Null or word-less texts have no shingles and no links. Rows without doc_id are not linked: component_id
    is null, kept true. Rows that share a doc_id are one node. An empty table gives no rows.
    """
    plan = _Plan(percent)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    all_ = materialize(sketches(docs, width))
    live = all_.filter("n_shingles > 0 and doc_id is not null")
    classes = live.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = materialize(live.join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", "rep", F.col("n_shingles").alias("n"), *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("regs", "low")]))
    reps = member.filter("regs is not null").select(F.col("rep").alias("id"), "n", "regs", "low").dropDuplicates(["id", "n"])

    bands = _explode_bands(reps, plan.rows)
    heads = bands.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    buckets = materialize(bands.join(heads, "bucket"))
    tried = materialize(_estimated(buckets.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), reps, plan))
    involved = buckets.select("id").distinct()
    texts = materialize(docs.join(involved, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text"))
    links = materialize(_verified(tried, texts, width, percent))
    same = member.filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    parts = components(links)

    placed = buckets.join(parts, F.col("id") == F.col("node"), "left").select("bucket", "id", "head", F.coalesce("component", "id").alias("part"))
    rest = materialize(_between_parts(placed, reps, plan).distinct())
    if not rest.isEmpty():
        links = links.unionByName(_verified(rest, texts, width, percent))
    parts = components(links.unionByName(same))
    out = all_.join(parts, all_["doc_id"] == parts["node"], "left")
    comp = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component of :func:`near_duplicates`; columns stay, so do rows without doc_id."""
    gone = near_duplicates(docs.select("doc_id", "text"), width, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(materialize(gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
