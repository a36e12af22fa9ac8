"""Personal data against the plain patterns, counts by hand and planted spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_corpus import docs, empty, rows  # noqa: F401
from pyspark.sql import functions as F

from tilequery.llm import private

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rng, n=16, start="4"):
    body = start + "".join(str(rng.randint(0, 9)) for _ in range(n - 1 - len(start)))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def texts():
    rng = random.Random(5)
    bits = [
        "a.b@c.com", "x@y", "a@b.c.d-x%y@z.com", "q@@r.org", "a@b@c.de", "@c.de", "m@n.org.", "é@b.com", "ab@b-.c", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.000.0255.1",
        "1.2.3", "1..2.3.4", "99999999999999999999.1.1.1", card(rng), card(rng, 19), card(rng, 13), card(rng, 15, "37"), "4111 1111 1111 1111", "4111-1111 1111-1111", "4111  1111 1111 1111",
        "4111111111111112", "0" * 13, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (017) 555-7713", "+4", "+44", "+1(", "+12345678", "+123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1.2.3.4.5.6.7.8.9-", "++49 30 123456",
        "name [at] host [dot] org", "10[.]0[.]0[.]1", "call (030) 1234-5678", "tel 0049 30 1234567", "555-123-4567", "😀", "日本", "x", " ", "-", ".", "+", "7", "\n", "visa " + card(rng) + " " + card(rng), "card 12 " + card(rng),
    ]
    out = [None, "", " "] + bits + ["".join(rng.choice(bits + [" "] * 20) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    out += ["".join(rng.choice("0123456789 .-+@ab()%é") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows_ = [(i if i % 50 else None, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows_, "doc_id long, text string, spans string, row int").repartition(3)
    return rows_, private.personal_data(df).collect()


def test_base(found):
    rows_, got = found
    want = Counter()
    for doc, text, _, _ in rows_:
        spans = base(text)
        n = Counter(k for k, _, _ in spans)
        want[doc, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(written(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_all_spans_keep_the_base(found):
    rows_, got = found
    by = {doc: text for doc, text, _, _ in rows_ if doc is not None}
    order = {k: i for i, k in enumerate(private.KINDS)}
    more = 0
    for r in got:
        if r.doc_id is None:
            continue
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (order[s[0]], s[1])) and set(base(by[r.doc_id])) <= set(spans)
        extra = [s for s in spans if s not in base(by[r.doc_id])]
        assert all(s[2] <= len(by[r.doc_id]) for s in spans)
        assert not any(a[1] < b[2] and b[1] < a[2] for a in extra for b in spans if a is not b)
        more += len(extra)
    assert more


def test_long_texts(spark):
    """Runs of a million signs are read in time proportional to them, thousands of spans keep their places."""
    long = ["a" * 1_000_000, "1" * 1_000_000, "1." * 300_000, "+1" + " " * 500_000, "a@" * 300_000, "x@y.com " * 20_000, "(1" * 200_000, "a." * 300_000 + "@b", "1 " * 400_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(4)
    for r in private.personal_data(df).collect():
        if r.doc_id == 5:
            spans = base(long[5])
            assert r.n_email == 20_000 and r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        elif r.doc_id == 2:
            assert r.n_ip == 75_000
        else:
            assert r.n_email == r.n_card == 0


def test_reliabilities():
    """Expectation-maximisation finds labelers' chances that were used to draw the votes."""
    rng = np.random.default_rng(2)
    truth = rng.random(40_000) < 0.3
    right = [0.95, 0.8, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where((rng.random(len(truth)) < p) == truth, 1, -1)) for p in right], 1)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    share, chance = private.reliabilities(patterns)
    assert abs(share - 0.3) < 0.03
    for c, p in zip(chance, right):
        assert abs(c[1][2] / (1 - c[1][1]) - p) < 0.04 and abs(c[0][0] / (1 - c[0][1]) - p) < 0.04
    # posterior by multiplying out
    v = (1, -1, 0, 1)
    a = share * math.prod(c[1][x + 1] for c, x in zip(chance, v))
    b = (1 - share) * math.prod(c[0][x + 1] for c, x in zip(chance, v))
    assert abs(private.posterior(share, chance, v) - a / (a + b)) < 1e-12


def test_train():
    """Newton steps reach the point where the penalised gradient vanishes."""
    rng = random.Random(1)
    data = [([0, 1 + rng.randrange(3), 4 + rng.randrange(2)], float(rng.randint(1, 30)), rng.random()) for _ in range(40)]
    w = private.train(data, 6)
    gradient = list(w)
    for indices, n, target in data:
        p = 1 / (1 + math.exp(-sum(w[i] for i in indices)))
        for i in indices:
            gradient[i] += n * (p - target)
    assert max(map(abs, gradient)) < 1e-6


def test_method_takes_other_spellings(spark):
    """Among many plain spans those in other spellings are taken, look-alikes are left."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows_, want, clean = [], {}, set()
    for i in range(600):
        plain = rng.choice([f"mail {word()}.{word()}@{word()}.com", f"server {rng.randint(1, 200)}.{rng.randint(0, 255)}.4.{rng.randint(0, 255)}", f"card {card(rng)}", f"call +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"])
        rows_.append((i, f"{word()} {word()} {plain} {word()} {word()}"))
    hard = [f"contact {word()} [at] {word()} [dot] com", f"server 23[.]45[.]6[.]7", f"card {card(rng)[:4]}.1", f"visa {card(rng)} {card(rng)}"]
    for j, t in enumerate([hard[0], hard[1], hard[3]]):
        want[1000 + j] = ("email", "ip", "card")[j]
        rows_.append((1000 + j, f"{word()} {t} {word()}"))
    for j, t in enumerate(["version 1.2.3 of part 12345", "order 4111111111111112 today", "in 1999-2003 and 2004-2008", "a [at] b", "12:30-14:45 2020", "x@y or @z"]):
        clean.add(2000 + j)
        rows_.append((2000 + j, f"{word()} {t} {word()}"))
    got = {r.doc_id: r for r in private.personal_data(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    for d, kind in want.items():
        assert kind in got[d].spans, (d, got[d])
    assert got[1002].spans.count("card:") == 2
    assert all(got[d].spans == "" for d in clean)


def test_awkward_tables(spark, docs, empty):  # noqa: F811
    assert private.personal_data(empty).count() == 0
    got = private.personal_data(docs).collect()
    assert len(got) == docs.count()
    assert private.personal_data(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).filter("spans = '' and n_email = 0").count() == len(got)


def test_no_python_on_executors(spark, docs):  # noqa: F811
    plan = private.candidates(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
