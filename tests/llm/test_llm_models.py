"""Sharding, packing, search and models against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_corpus import docs, empty, lower, rows, words  # noqa: F401
from pyspark.sql import functions as F

from tilequery.llm import langid, nearest, packing, pitmanyor, queries, sharding, toxicity

TOKENIZER = __import__("public_tokenizers").path("byte_bpe_50k.json")


def test_shards(spark, docs, empty):
    put = sharding.assign_shards(docs.select("doc_id"), "doc_id", [1, 2, 1], [1, 2, 1, 3]).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in put)
    big = spark.range(20_000).withColumnRenamed("id", "k")
    sizes = Counter(r.shard for r in sharding.assign_shards(big, "k", [1, 2, 1, 0]).collect())
    assert set(sizes) == {0, 1, 2} and abs(sizes[1] / 20_000 - 0.5) < 0.02
    slots = sharding.number_slots(sharding.assign_shards(docs.select("doc_id", "text"), "doc_id", [1.0] * 3), ["doc_id"], rows=20).collect()
    by = defaultdict(list)
    for r in slots:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.number_slots(sharding.assign_shards(empty.select("doc_id"), "doc_id", [1.0]), ["doc_id"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text("ab' 12\n.,!éÉstmdrvelL\t\xa0日<|>", max_size=30), st.sampled_from(["a<|endoftext|>b", "it's they'll 'tis I'd", "  x  \n\n y "])), max_size=6))
def test_token_ids(texts):
    ids = packing.TokenIds(TOKENIZER)
    got = ids.encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [e.ids for e in ids.bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_pieces(pieces, docs, length):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    have = Counter()
    for d, text in docs:
        ids = np.append(np.array(t.encode(text or "", add_special_tokens=False).ids, np.uint32), np.uint32(0)).astype("<u4")
        for at in range(0, len(ids), length):
            have[d, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes()), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == have
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_packing(docs, rows, empty):
    pieces = packing.pack(docs, TOKENIZER, length=64, windows=3).collect()
    n = check_pieces(pieces, [(d, t) for d, t, *_ in rows], 64)
    assert n * 64 <= 1.1 * sum(p.length for p in pieces)
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[40:60] = x[40]
    vectors = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [float("inf")] * 16), (None, vectors[0][1]), (1020, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in nearest.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    exact = x.astype(float)
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        s = exact @ exact[q]
        s[q] = -np.inf
        assert all(abs(s[v] - score) < 1e-9 for _, v, score in found)
        assert all((a[2], -a[1]) >= (b[2], -b[1]) for a, b in zip(found, found[1:]))
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(600), -s))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = nearest.nearest(df.filter("vec_id < 5"), "vec_id", "embedding", F.col("vec_id") == 0)
    assert [r.vec_id for r in few.orderBy("rank").collect()].__len__() == 4
    assert nearest.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0


def test_sharded_search_agrees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.standard_normal((400, 8)))], "vec_id long, embedding array<double>")
    whole = nearest.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    monkeypatch.setattr(nearest, "SHARD_ROWS", 90)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 3)
    parts = nearest.nearest(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    assert len(set(whole) & set(parts)) >= 0.9 * len(whole) == 0.9 * len(parts)


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_language(spark, empty):
    rng = random.Random(1)
    kinds = {"ab": "abcde", "de": "defgé", "ru": "жзиклм"}
    train = [(i, speech(rng, kinds[k], rng.randint(5, 60)).capitalize(), k) for i, k in enumerate(list(kinds) * 30)] + [(900, None, "ab"), (901, "x", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.model.languages == ["ab", "de", "ru"]
    code = np.arange(256, dtype=np.uint32)  # every sign after three ends of words
    assert np.allclose(np.exp(model.model.logs(code)).sum(0), 1, atol=1e-3)
    test = [(i, speech(rng, kinds[k], 12), k) for i, k in enumerate(list(kinds) * 10)] + [(100, None, ""), (101, "", ""), (102, "12 .. !", ""), (103, "日本" * 20, "")]
    df = spark.createDataFrame(test, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in model.predict(df).collect()}
    assert all(got[i].lang_pred == k for i, _, k in test[:30])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102, 103))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(empty) is None


def test_restored_words():
    codes = Counter()
    text = "you are an idiot and a clown stupid people say worthless things " * 3
    for a, b, c in zip("  " + text, " " + text + " ", text + " "):
        at = [toxicity._CODE.get(x, 0) for x in (a, b, c)]
        codes[(at[0] << 12) | (at[1] << 6) | at[2]] += 1
    channel = toxicity.Channel(np.array(list(codes)), np.array(list(codes.values()), float))
    plain = {"cl0wn": "clown", "1diot": "idiot", "s t u p i d": "stupid", "stuuuupid": "stupid", "w.o.r.t.h.l.e.s.s": "worthless", "$tup1d": "stupid"}
    texts = [None, "", *[f"you {k} people" for k in plain], "people say things", "ééé 123 4-5"]
    assert toxicity.restore_texts(pa.array(texts, pa.string()), channel).to_pylist()[2:-2] == [f"you {v} people" for v in plain.values()]
    assert toxicity.restore_texts(pa.array(texts, pa.string()), channel).to_pylist()[:2] == [None, ""]


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        t = speech(rng, "abcdefghi", 30).split()
        if i % 5 == 0:
            t[7] = rng.choice(["grumbo", "Grumbo", "gr-umbo"]) if i % 10 else "vexify"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, int(i % 5 == 0)) for i in range(400)], (1000, 0), (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r.score for r in model.score(df).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert 0 <= got[1000] == got[1001] < 0.5
    assert model.score(docs, "__s").columns == [*docs.columns, "__s"]
    assert toxicity.fit(empty, labels.limit(0)).score(empty).count() == 0


def test_language_model(docs, rows, empty):
    got = pitmanyor.score_texts(docs, F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False)), shards=3).collect()
    tokens = {(d, t): [*words(lower(t)), None] for d, t, *_ in rows}
    train = Counter(w for d, t, *_ in rows if d is not None and d % 3 for w in tokens[d, t])
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(x), sum(train[w] > 0 for w in x), round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), 5)) for (d, t, *_) in rows for x in [tokens[d, t]])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    held = [r for r in got if r.doc_id is not None and r.doc_id % 3 == 0]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitmanyor.score_texts(empty, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in pitmanyor.score_texts(docs, F.lit(False)).collect())


def rows_from_python(plan) -> int:
    """Rows that the MapInArrow nodes of an executed plan gave back."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_from_python(plan.executedPlan())
    if name.endswith("QueryStage"):
        return rows_from_python(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("pythonNumRowsReceived").value() if name == "MapInArrow" else 0
    return own + sum(rows_from_python(below.apply(k)) for k in range(below.size()))


def test_language_model_sends_nothing_by_document_and_shard(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, speech(rng, "abcdefghi", 40)) for i in range(60)], "doc_id long, text string").coalesce(1)
    few, many = (pitmanyor.score_texts(docs, F.col("doc_id") % 3 != 0, shards=n) for n in (1, 12))
    assert sorted(r.base_score for r in few.collect()) == pytest.approx(sorted(r.base_score for r in many.collect()))
    assert 0 < rows_from_python(many._jdf.queryExecution().executedPlan()) <= 12


def test_every_word_before_is_a_context_of_its_own(spark):
    """Words that a table of 16,384 restaurants would seat together each keep their own followers."""
    from tilequery.llm.text import Words, mix

    names = [f"w{i}" for i in range(3000)]
    hashes = Words(pa.array([" ".join(names)]), lower=True).hashes()
    place: dict[int, str] = {}
    pairs = [(place[b], n) for n, b in zip(names, (mix(hashes) % np.uint64((1 << 14) - 1)).tolist()) if place.setdefault(b, n) != n]
    one, other = pairs[0]
    assert len({pitmanyor.Tokens(pa.array([f"{one} a", f"{other} a", "a"])).context[k] for k in (0, 1, 4)}) == 3
    texts = [f"{one} left"] * 40 + [f"{other} right"] * 40
    asked = [f"{one} left", f"{one} right", f"{other} right", f"{other} left"]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(asked))], "doc_id long, text string")
    for shards in (1, 3):
        got = {r.doc_id: r.score for r in pitmanyor.score_texts(docs, F.col("doc_id") < 1000, shards=shards).collect()}
        assert got[1000] > got[1001] + 0.8 and got[1002] > got[1003] + 0.8


def test_totals_of_contexts_meet_from_all_shards(spark):
    """Customers and tables of a context are sums over the shards that hold cells of it."""
    rng = np.random.default_rng(3)
    contexts = np.unique(rng.integers(1, 1 << 62, 40).astype(np.uint64) * np.uint64(4))
    records, customers, cells, beyond = [], Counter(), Counter(), Counter()
    for shard in range(3):
        own = np.sort(rng.choice(contexts, 25, replace=False))
        cell = np.unique(rng.integers(0, 6, 60) * len(own) + rng.integers(0, len(own), 60))
        n, more = rng.integers(1, 9, len(cell)), rng.integers(0, 4, len(own)).astype(np.uint32)
        for c, k in zip(own[cell % len(own)].tolist(), n.tolist()):
            customers[c] += k
            cells[c] += 1
        for c, k in zip(own.tolist(), more.tolist()):
            beyond[c] += k
        parts = {"contexts": own.tobytes(), "counts": pitmanyor._pack(cell.astype(np.int64), n.astype(np.int64))}
        records.append((shard, parts | {"beyond": [(h, pitmanyor._pack(more[x:y])) for h, x, y in pitmanyor._stretches(own, 3)]}))
    held = spark.sparkContext.parallelize(records).partitionBy(3, pitmanyor._own)
    totals = pitmanyor.Totals(held, 3)
    sent = held.flatMap(lambda e: [(home, {("beyond", e[0]): blob}) for home, blob in e[1]["beyond"]]).partitionBy(3, pitmanyor._own)
    got = held.union(totals.fixed).union(totals.added(sent, 1)).mapPartitions(lambda r: pitmanyor._merged(r).items()).collect()
    assert sorted(s for s, _ in got) == [0, 1, 2]
    for _, part in got:
        own = np.frombuffer(part["contexts"], np.uint64).tolist()
        for kind, want in (("customers", customers), ("cells", cells), (1, beyond)):
            assert pitmanyor._arrays(part, kind).tolist() == [want[c] for c in own]


def test_seating_follows_the_process():
    rng = np.random.default_rng(0)
    customers, d, a = np.full(4000, 30), 0.6, 1.5
    got = pitmanyor.seat(customers, np.full(4000, a), d, rng).mean()
    tables = np.ones(20000)
    for i in range(1, 30):
        tables += rng.random(20000) < a / (a + i - d * tables)
    assert abs(got - tables.mean()) < 0.1
    assert pitmanyor.seat(np.array([0, 1, 5000]), np.full(3, 1e-9), d, rng).tolist() == [0, 1, 1]


def test_predictions_sum_to_one():
    """Over all known words and the new type, in the root and in every context, with the totals the tables lead to."""
    rng = np.random.default_rng(4)
    vocabulary = np.sort(rng.integers(1, 1 << 62, 50).astype(np.uint64))
    cells = np.unique(rng.integers(0, 50, 400) * pitmanyor.CONTEXTS + rng.integers(0, 9, 400))
    cells = np.unique(np.concatenate([cells, np.arange(50) * pitmanyor.CONTEXTS]))
    n = rng.integers(1, 30, len(cells))
    customers = np.bincount(cells % pitmanyor.CONTEXTS, n, minlength=pitmanyor.CONTEXTS)
    start = pitmanyor.State(50, (0.6, 0.7), customers, np.bincount(cells % pitmanyor.CONTEXTS, minlength=pitmanyor.CONTEXTS).astype(float), 50.0, np.zeros(0, np.uint64), np.zeros(0))
    tables, own, root_tables = pitmanyor._sweep(start, vocabulary, cells, n, (0, 0))
    after = pitmanyor.State(50, (0.6, 0.7), customers, np.bincount(cells % pitmanyor.CONTEXTS, tables, minlength=pitmanyor.CONTEXTS), root_tables.sum(), np.zeros(0, np.uint64), np.zeros(0))
    root = after.root(own, root_tables)
    assert root.sum() + after.unknown() == pytest.approx(1)
    for c in range(10):
        mine = cells % pitmanyor.CONTEXTS == c
        left = (pitmanyor.CONCENTRATION + 0.7 * after.tables[c]) / (pitmanyor.CONCENTRATION + customers[c])
        known = ((n - 0.7 * tables)[mine]).sum() / (pitmanyor.CONCENTRATION + customers[c]) + left * root.sum()
        assert known + left * after.unknown() == pytest.approx(1)


NAMES = [n for n in queries.QUERIES if n.startswith("op")]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_over_the_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n, docs = df.count(), spark.read.parquet(f"{SF}/documents.parquet").count()
    if name.split("_")[0][2:] in ("2", "4", "7", "8", "9", "10", "11", "13"):
        assert n == docs and df.select("doc_id").distinct().count() == docs
    else:
        assert n > 0


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, now, SF).cache()
        assert after.columns == docs.columns, name
        assert after.select("doc_id").exceptAll(now.select("doc_id")).count() == 0
        now = after
    pieces = c.packed(spark, now, SF).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()], 1024)
    whole = c.run(spark, SF).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)


def test_models_open_without_this_package(spark, docs):
    """What is sent to the tasks brings its classes along: a Python that cannot import the package opens and uses it."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = langid.fit(docs.select(F.col("doc_id").cast("long"), "text", "lang"))
    for thing, use in ((model, "x.model.languages, x.limits"), (pitmanyor.State(3, (0.5, 0.5), np.ones(4), np.ones(4), 2.0, np.zeros(0, np.uint64), np.zeros(0)), "x.unknown()")):
        code = f"import sys, pickle; x = pickle.loads(sys.stdin.buffer.read()); print({use}); assert not any(m.startswith('tilequery') for m in sys.modules)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        run = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(thing), capture_output=True, cwd="/tmp", env=env, timeout=60)
        assert run.returncode == 0, run.stderr.decode()[-800:]
