"""Toxicity of texts: noisy-channel restoration of disguised words, then a linear model on the restored words."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilequery.llm.folds import fold, hashed_sample
from tilequery.llm.text import NO_LETTER, Words, blocks, text_buffers
from tilequery.session import materialize

#: labelled documents the classifier is fitted on, at most
MAX_LABELLED = 30_000
#: word and word-beginning features looked at, and kept, at most
MAX_SEEN, MAX_FEATURES = 50_000, 4096
PREFIXES = (4, 5, 6, 7, 8)

# Letters that look like a digit or sign, common in disguised words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
_LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_CODE = {c: i + 1 for i, c in enumerate(_LATIN)}
_OTHER = len(_LATIN) + 1
_BITS = 6


def _letter_codes() -> np.ndarray:
    """Code of each character below 0x250: 0 no letter, 1.. the alphabet's letters in either case, then one for other letters."""
    out = np.zeros(0x251, np.int32)
    for c in range(0x250):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = _CODE.get(chr(c).lower(), _OTHER)
    out[0x250] = _OTHER
    return out


def letter_trigrams(docs: DataFrame) -> DataFrame:
    """``code, n``: counts of letter trigrams (word ends are one sign) over all whole texts; at most 2**18 rows."""

    def run(batches):
        codes = _letter_codes()
        total = np.zeros(1 << (3 * _BITS), np.int64)
        for batch in batches:
            for part in blocks(batch):
                raw, at = text_buffers(part.column("text"))
                points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                c = codes[np.minimum(points, 0x250)]
                c = c[np.r_[True, (c[1:] > 0) | (c[:-1] > 0)]] if len(c) else c  # one sign between words
                c = np.concatenate([[0, 0], c, [0]])
                total += np.bincount((c[:-2] << (2 * _BITS)) | (c[1:-1] << _BITS) | c[2:], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores a disguised string: the likeliest letters under a trigram character model and the costs of disguising them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        size = 1 << _BITS
        three = np.zeros(size**3)
        three[codes] = counts
        three = three.reshape(size, size, size)
        symbols = _OTHER + 1
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one[:symbols] + 0.5) / (one[:symbols].sum() + 0.5 * symbols)
        p2 = (two[:symbols, :symbols] + 5 * p1) / (two[:symbols, :symbols].sum(1, keepdims=True) + 5)
        p3 = (three[:symbols, :symbols, :symbols] + 5 * p2[None]) / (three[:symbols, :symbols, :symbols].sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)
        self.letters = " " + _LATIN + "?"
        self.known: dict[str, str] = {}

    def options(self, c: str, before: str, run: int) -> list[tuple[int, float]]:
        """What a sign may stand for: (letter code, 0 for a word end, or -1 for nothing; cost)."""
        if c.isalpha():
            same = [(-1, 0.5 if run >= 3 else 4.0)] if c == before else []
            return [(_CODE.get(c, _OTHER), 0.0), *same]
        if c in LEET:
            return [*[(_CODE[x], 1.0) for x in LEET[c]], (0, 4.0), (-1, 8.0)]
        if c.isspace():
            return [(-1, 1.0), (0, 1.0)]
        return [(0, 0.5), (-1, 1.5)]

    def restore(self, text: str) -> str:
        """The likeliest plain reading of a lower-case string (Viterbi over the lattice of readings, state: the last two letters)."""
        if text in self.known:
            return self.known[text]
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        runs, k = [0] * len(text), 0
        for i, c in enumerate(text):  # length of the run of equal letters each sign is in
            if i and c != text[i - 1]:
                runs[k:i] = [i - k] * (i - k)
                k = i
        runs[k:] = [len(text) - k] * (len(text) - k)
        for i, c in enumerate(text):
            after: dict = {}
            choices = self.options(c, text[i - 1] if i else "", runs[i])
            for (a, b), (cost, path) in states.items():
                for code, extra in choices:
                    if code < 0 or (code == 0 and b == 0):
                        key, total, way = (a, b), cost + extra, path
                    else:
                        key, total, way = (b, code), cost + extra + float(self.cost[a, b, code]), (path, code)
                    if key not in after or total < after[key][0]:
                        after[key] = (total, way)
            states = after
        best = min(states.items(), key=lambda s: s[1][0] + (float(self.cost[s[0][0], s[0][1], 0]) if s[0][1] else 0.0))[1][1]
        out = []
        while best:
            best, code = best
            out.append(self.letters[code])
        restored = "".join(reversed(out)).strip()
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[text] = restored
        return restored


_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letter, 2 other
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[~NO_LETTER] = 1
_LEET_BYTE = np.zeros(256, bool)
_LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128]] = True


def disguised(texts: pa.Array) -> list[tuple[int, int, int]]:
    """(text, start, end) in bytes of every stretch that may hide a word: letters with other signs between them, with a look-alike
    before or one after them, with three equal letters in a row, or three or more single letters spaced out."""
    words = Words(texts)
    raw, at = words.raw, words.text_at
    n = len(raw)
    if not n or not len(words.start):
        return []
    cls = _CLASS[raw]
    cut = np.ones(n, bool)
    cut[1:] = cls[1:] != cls[:-1]
    cut[at[(at > 0) & (at < n)]] = True
    starts = np.flatnonzero(cut)
    kind = np.concatenate([[0], cls[starts], [0]])
    ends = np.append(starts[1:], n)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    mid = kind[1:-1] == 2
    before = (kind[:-2] == 1) & ~edge[starts]
    after = (kind[2:] == 1) & ~edge[ends]
    odd = mid & before & after
    odd |= mid & ~before & after & _LEET_BYTE[raw[ends - 1]] & (ends - starts <= 2)
    odd |= mid & before & ~after & _LEET_BYTE[raw[starts]] & (ends - starts == 1) & (raw[starts] != ord("!"))
    hits = [starts[odd]]
    triple = np.flatnonzero((cls[2:] == 1) & (raw[2:] < 128) & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])) + 2 if n > 2 else np.zeros(0, np.int64)
    hits.append(triple)
    marks = np.zeros(len(words.start), bool)
    marks[np.searchsorted(words.start, np.concatenate(hits), "right") - 1] = True
    size = words.end - words.start
    single = (cls[words.start] == 1) & ((size == 1) | ((size == 2) & (raw[words.start] >= 128)))
    group = np.arange(len(marks))
    if single.any():
        joined = np.zeros(len(single), bool)  # goes on from the word before
        joined[1:] = single[1:] & single[:-1] & (words.start[1:] - words.end[:-1] == 1) & ~edge[words.start[1:]]
        head = np.cumsum(~joined) - 1
        sizes = np.bincount(head)
        spaced = joined & (sizes[head] >= 3)
        first = np.flatnonzero(~joined)[head]
        group[spaced] = first[spaced]
        marks[spaced] = True
        marks[first[spaced]] = True
    chosen = np.flatnonzero(marks)
    if not len(chosen):
        return []
    g = group[chosen]
    cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    first, last = chosen[cuts], chosen[np.append(cuts[1:], len(chosen)) - 1]
    owner = np.searchsorted(words.doc, first, "right") - 1
    return list(zip(owner.tolist(), (words.start[first] - at[owner]).tolist(), (words.end[last] - at[owner]).tolist()))


def restore_texts(texts: pa.Array, channel: Channel) -> pa.Array:
    """Lower-case texts with disguised stretches replaced by their likeliest reading; nulls stay."""
    texts = pc.utf8_lower(texts)
    found = disguised(texts)
    if not found:
        return texts
    out = texts.to_pylist()
    spans: dict[int, list] = {}
    for i, a, b in found:
        spans.setdefault(i, []).append((a, b))
    for i, parts in spans.items():
        raw, done, pieces = out[i].encode("utf-8"), 0, []
        for a, b in parts:
            pieces += [raw[done:a], channel.restore(raw[a:b].decode("utf-8", "replace")).encode("utf-8")]
            done = b
        out[i] = b"".join([*pieces, raw[done:]]).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def word_features(texts: pa.Array):
    """Hashes of every word (letters only) and of its beginnings, and the text each belongs to; ``texts`` are lower-case."""
    words = Words(texts, gaps=NO_LETTER)
    spans = words.spans()
    owner = np.repeat(np.arange(len(texts)), words.counts())
    size = words.end - words.start
    h, who = [spans.hashes(words.start, words.end)], [owner]
    for p in PREFIXES:
        long = size > p
        h.append(spans.hashes(words.start[long], words.start[long] + p) ^ np.uint64(p))
        who.append(owner[long])
    return h, who


class Lookup:
    """Positions of 64-bit hashes in a sorted table; a bit table turns most strangers away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are in the table, and where."""
        near = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return near[:0], near[:0]
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        ok = self.keys[at] == h[near]
        return near[ok], at[ok]


def _present(texts: pa.Array, table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a block."""
    hits, owners = [], []
    for h, who in zip(*word_features(texts)):
        near, at = table.find(h)
        hits.append(at)
        owners.append(who[near])
    pairs = np.unique(np.concatenate(owners) * len(table.keys) + np.concatenate(hits)) if len(table.keys) else np.zeros(0, np.int64)
    return (pairs // len(table.keys), pairs % len(table.keys)) if len(table.keys) else (pairs, pairs)


def fit_linear(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, n_features: int, penalty: float = 0.3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with a quadratic penalty (full-batch Adam); returns weights and intercept."""
    n = max(1, len(labels))
    w = np.zeros(n_features + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[columns], minlength=n)[:n] + w[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels
        g = np.append(np.bincount(columns, r[rows], minlength=n_features) + penalty * w[:-1], r.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


class Model:
    """Trigram counts, feature hashes, weights and intercept; small and of bounded size, so it travels with the tasks."""

    def __init__(self, codes, counts, features, weights, intercept):
        self.codes, self.counts, self.features, self.weights, self.intercept = codes, counts, features, weights, intercept

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with ``name``: the probability of toxicity of each whole text; a null or word-less text has the base probability."""
        model = docs.sparkSession.sparkContext.broadcast((self.codes, self.counts, self.features, self.weights, self.intercept))

        def run(batches):
            codes, counts, features, weights, intercept = model.value
            channel, table = Channel(codes, counts), Lookup(features)
            for batch in batches:
                for part in blocks(batch):
                    texts = restore_texts(part.column("text"), channel)
                    who, what = _present(texts, table)
                    z = np.bincount(who, weights[what], minlength=part.num_rows) + intercept if len(who) else np.full(part.num_rows, intercept)
                    score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, name])

        schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
        return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from ``docs`` (doc_id, text; the character model counts all of them) and ``labels`` (doc_id, toxic 0/1).

    Only documents whose fold of three is not 1 lend their label, and of those the ``max_labelled`` with the smallest hash of
    doc_id. Features are words and word beginnings of restored texts that at least two toxic documents have; those
    that tell the classes apart best are weighted by logistic regression. Null labels are ignored, a
    document with two labels counts as toxic if one says so. Without labelled documents every score is 0.
    """
    spark = docs.sparkSession
    grams = letter_trigrams(docs).orderBy("code").toPandas()
    codes, counts = grams["code"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    chosen = hashed_sample(known.filter(fold(F.col("doc_id"), 3) != 1), "doc_id", max_labelled)
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_label"))
    channel = spark.sparkContext.broadcast((codes, counts))

    def seen(batches):
        """Features of toxic documents and in how many they are."""
        own = Channel(*channel.value)
        for batch in batches:
            for part in blocks(batch):
                h, who = word_features(restore_texts(part.column("text"), own))
                h, who = np.concatenate(h), np.concatenate(who)
                order = np.lexsort((who, h))
                h, who = h[order], who[order]
                first = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])][: len(h)]
                keys, n = np.unique(h[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["f", "n"])

    toxic = sample.filter("_label = 1").select("text").mapInArrow(seen, "f long, n long")
    common = toxic.groupBy("f").agg(F.sum("n").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "f").limit(MAX_SEEN).toPandas()
    order = np.argsort(common["f"].to_numpy(np.int64).view(np.uint64))
    keys, n1 = common["f"].to_numpy(np.int64).view(np.uint64)[order], common["n"].to_numpy(np.float64)[order]

    def clean(batches):
        own, table = Channel(*channel.value), Lookup(keys)
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in blocks(batch):
                total += np.bincount(_present(restore_texts(part.column("text"), own), table)[1], minlength=len(keys))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    t1, t0 = sizes.get(1, 0), sizes.get(0, 0)
    n0 = np.zeros(len(keys))
    if len(keys):
        rest = sample.filter("_label = 0").select("text").mapInArrow(clean, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        n0[rest["at"].to_numpy(np.int64)] = rest["n"].to_numpy(np.float64)
    odds = np.log((n1 + 0.1) / (t1 + 1)) - np.log((n0 + 0.1) / (t0 + 1))
    gain = np.where(odds > 0, odds * np.sqrt(n1), 0)
    best = np.sort(np.argsort(-gain, kind="stable")[:MAX_FEATURES])
    best = best[(odds[best] > 1.0)]
    keys = keys[best]

    def train(batches):
        own, table = Channel(*channel.value), Lookup(keys)
        rows, columns, labels_, n = [], [], [], 0
        for batch in batches:
            for part in blocks(batch):
                r, c = _present(restore_texts(part.column("text"), own), table)
                rows.append(r + n)
                columns.append(c)
                labels_.append(part.column("_label").to_numpy(zero_copy_only=False))
                n += part.num_rows
        if n:
            w, b = fit_linear(np.concatenate(rows), np.concatenate(columns), np.concatenate(labels_).astype(float), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(w))]), pa.array([b, *w.tolist()])], ["at", "w"])

    found = dict(map(tuple, sample.select("text", "_label").coalesce(1).mapInArrow(train, "at long, w double").collect())) if t1 and t0 else {}
    weights = np.array([found.get(i, 0.0) for i in range(len(keys))])
    return Model(codes, counts, keys, weights, found.get(-1, 35.0 if t1 and not t0 else -35.0))
