"""Text kernels, line dedup, near copies, substring dedup and tiling against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import Groups, docs, edit_distance, empty, lower, rows, words  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilequery.llm import lines, repeats, sketch, tiling
from tilequery.llm.components import components
from tilequery.llm.text import Words, blocks, shingle_hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab é\t\n\x0b\x1f\xa0ß", max_size=20)), max_size=8))
def test_words_of_texts(texts):
    found = Words(pa.array(texts, pa.string()))
    raw = found.raw.tobytes()
    got = [[raw[found.start[k] : found.end[k]].decode() for k in range(found.doc[i], found.doc[i + 1])] for i in range(len(texts))]
    assert got == [words(t) for t in texts]
    same: dict = {}
    for text, h in zip([w for t in texts for w in words(t)], found.hashes().tolist()):
        assert same.setdefault(text, h) == h
    assert len(set(same.values())) == len(same)
    h, many = shingle_hashes(found.hashes(), found.counts(), 3)
    assert many.tolist() == [max(len(words(t)) - 2, min(1, len(words(t)))) for t in texts]
    assert len(h) == sum(many)


def test_blocks_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 5, 900, 3, 3, 0)]})
    assert [p.num_rows for p in blocks(batch, size=10)] == [2, 1, 3]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 3), (200, 200), (100, 103)]
    want = Groups()
    for a, b in edges:
        want.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want.find(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = np.random.default_rng(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice(list("abé"), rng.integers(0, 25)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(0, len(b) + 1))
            b[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abé"), rng.integers(0, 2)))
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", lines.edit_distance(F.col("a"), F.col("b"), edits))
    for r in df.collect():
        true = edit_distance(r.a, r.b)
        assert (r.d == true) if true <= edits else (r.d > edits)


def line_truth(rows, edits, least):
    at = [(d, i, l) for d, t, *_ in rows if t is not None for i, l in enumerate(t.split("\n"))]
    distinct = sorted({l for *_, l in at})
    groups = Groups()
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                groups.join(a, b)
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first: dict = {}
    for d, i, l in at:
        if l.strip(" "):
            g = groups.find(l)
            first[g] = min(first.get(g, (d, i)), (d, i), key=key)
    return {(d, i, l): first[groups.find(l)] if l.strip(" ") else (d, i) for d, i, l in at}


def test_line_classes(docs, rows):
    want = line_truth(rows, 2, 24)
    got = lines.line_classes(docs).collect()
    assert len(got) == sum(len(t.split("\n")) for _, t, *_ in rows if t is not None)
    texts = defaultdict(set)
    for d, i, l in want:
        texts[d, i].add((len(l), want[d, i, l]))
    for r in got:
        assert (r.chars, (r.first_doc_id, r.first_line_no)) in texts[r.doc_id, r.line_no]
        assert r.kept == ((r.doc_id, r.line_no) == (r.first_doc_id, r.first_line_no))


def test_lines_dropped(docs, rows, empty):
    want = line_truth(rows, 2, 24)
    got = sorted(map(tuple, lines.drop_repeated_lines(docs).select("doc_id", "text").collect()), key=str)
    out = []
    for d, t, *_ in rows:
        if t is None:
            out.append((d, None))
            continue
        ls = t.split("\n")
        kept = [l for i, l in enumerate(ls) if want[d, i, l] == (d, i)]
        if len(kept) == len(ls) or any(l.strip(" ") for l in kept):
            out.append((d, "\n".join(kept)))
    assert got == sorted(out, key=str)
    assert lines.drop_repeated_lines(empty).columns == docs.columns
    assert lines.drop_repeated_lines(empty).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, width, percent):
    def shingles(t):
        w = words(lower(t))
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t, *_ in rows]
    groups = Groups()
    live = [(d, s) for d, s in sets if s and d is not None]
    for i, (a, x) in enumerate(live):
        for b, y in live[i + 1 :]:
            if 100 * len(x & y) >= percent * len(x | y):
                groups.join(a, b)
    want = sorted(((d, len(s), None if d is None else groups.find(d), d is None or groups.find(d) == d) for d, s in sets), key=str)
    assert sorted(map(tuple, sketch.near_duplicates(docs, width, percent).collect()), key=str) == want
    assert sketch.near_duplicates(empty, width, percent).count() == 0


def test_near_copies_of_one_hot_group(spark, monkeypatch):
    """Many copies with one or two words changed: members that the bucket's head does not link are tried block by block."""
    monkeypatch.setattr(sketch, "BLOCK_MEMBERS", 16)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        t = list(base)
        for k in rng.integers(0, 60, rng.integers(1, 4)):
            t[k] = f"v{rng.integers(0, 3)}"
        texts.append(t)
    sets = [{tuple(t[i : i + 3]) for i in range(58)} for t in texts]
    groups = Groups()
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                groups.join(i, j)
    got = sketch.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), 3, 85)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: groups.find(i) for i in range(120)}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64)) for _ in range(2)]
    mixed = np.unique(np.concatenate([sets[0][:2700], sets[1][:300]]))
    r = sketch.registers([sets[0], mixed, np.unique(np.concatenate([sets[0], mixed]))])
    assert (np.maximum(r[0], r[1]) == r[2]).all()  # mergeable
    more, equal = (r[0] > r[1]).sum(), (r[0] == r[1]).sum()
    est = sketch.likely(np.array([equal]), np.array([more]), np.array([64 - equal - more]), np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(est - 2700 / 3300) < 0.2


@pytest.mark.parametrize("shards", [1, 5])
def test_repeats_removed(docs, rows, empty, shards):
    texts = sorted({(d, t) for d, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    twice = {d for d, _ in texts if sum(x == d for x, _ in texts) > 1}
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in repeats.drop_repeats(docs, 20, shards).collect()}
    seen: set = set()
    want = set()
    for d, t in texts:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(k)
        want.add((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert {g for g in got if g[0] not in twice} == {g for g in want if g[0] not in twice}
    assert repeats.drop_repeats(docs, 20, shards).count() == len(rows)
    assert repeats.drop_repeats(empty, 20).count() == 0


def test_repeats_of_hot_passage(spark, docs):
    """A passage that many texts share between other words: its edges' anchors are spread, what is found stays."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    other = lambda: " ".join(f"x{i}" for i in rng.integers(0, 1 << 40, 30))
    texts = [(i, f"{other()} {passage} {other()}") for i in range(1500)]
    many = docs.select("doc_id", "text").filter("doc_id is not null").unionByName(spark.createDataFrame([(i + 10_000, t) for i, t in texts], "doc_id long, text string"))
    removed = {r.doc_id: r.n_removed for r in repeats.drop_repeats(many, 20, 16).filter("doc_id >= 10000").collect()}
    assert removed[10_000] == 0 and {removed[i + 10_000] for i in range(1, 1500)} == {60}
    split = sorted(map(tuple, repeats.drop_repeats(many, 20, 16, hot=3).collect()))
    assert split == sorted(map(tuple, repeats.drop_repeats(many, 20, 16, hot=1 << 30).collect()))
    keyed = many.withColumn("row", F.xxhash64("doc_id", "text")).filter("doc_id >= 10000")
    size = lambda hot: [r.n or 0 for r in repeats._sent(keyed, 20, 16, hot).groupBy("shard").agg((F.sum(F.length("words")) / 5).alias("n")).collect()]
    whole, parts = size(1 << 30), size(100)
    assert max(whole) > 0.4 * sum(whole)  # unsplit, an edge is one shard
    assert len(parts) == 16 and max(parts) < 0.15 * sum(parts)


def test_fm_index_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (30, 7, 50)])
    index = repeats.FMIndex(text, 5)
    for _ in range(60):
        i = rng.integers(0, len(text) - 5)
        pattern = text[i : i + 5]
        if (pattern == 0).any():
            continue
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        where = [k for k in range(len(text) - 4) if (text[k : k + 5] == pattern).all()]
        assert sorted(index.places[low[0] : high[0]].tolist()) == where
        assert index.places[low[0]] == where[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25))
def test_tiles_are_greedy(doc, item):
    d, m = (np.array(x, np.uint64) for x in (doc, item))
    got = tiling.tiles(d, m, 3)
    used_d, used_m, want = set(), set(), []
    while True:  # the longest match of unmarked words, the earliest of equals
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_d and j + n not in used_m:
                    n += 1
                if n >= 3 and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            break
        want.append(best)
        used_d |= set(range(best[0], best[0] + best[2]))
        used_m |= set(range(best[1], best[1] + best[2]))
    assert sorted(got) == sorted(want)


def test_contaminated(spark, docs, rows, empty):
    items = [(i, t) for i, (_, t, *_) in enumerate(rows[:8])] + [(50, None), (51, "too short"), (None, rows[2][1])]
    first = rows[7][1].replace("\n", " ").split(" ")
    reordered = " ".join(first[len(first) // 2 :]).upper() + " between " + " ".join(first[: len(first) // 2])
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, reordered)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    sent = sorted(map(tuple, tiling.contaminated(more, bench).collect()), key=str)
    joined = sorted(map(tuple, tiling.contaminated(more, bench, shipped=0).collect()), key=str)
    assert sent == joined
    found = {(r[1], r[2]) for r in sent}
    assert {(i, i) for i in range(8)} <= found and (900, 7) in found
    assert not {d for d, _ in found} & {22, 23, 24, 30}
    assert tiling.drop_contaminated(docs, bench).columns == docs.columns
    assert tiling.contaminated(empty, bench).count() == 0
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0


def test_contaminated_by_repeated_item(spark):
    """An item given twice is found as the same item given once, however the benchmark is joined."""
    item = [f"w{i}" for i in range(60)]
    chunks = [item[i : i + 5] for i in range(0, 60, 5)]
    text = " ".join(w for c in chunks[::-1] for w in [*c, "other"])
    docs = spark.createDataFrame([(1, text), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))] * 2 + [(8, " ".join(item))], "item_id long, text string")
    sent = sorted(map(tuple, tiling.contaminated(docs, bench).collect()))
    joined = sorted(map(tuple, tiling.contaminated(docs, bench, shipped=0).collect()))
    assert [r[1:4] for r in sent] == [(1, 7, 60)] * 2 + [(1, 8, 60)]
    assert sent == joined
    assert [r.doc_id for r in tiling.drop_contaminated(docs, bench, shipped=0).collect()] == [2]
