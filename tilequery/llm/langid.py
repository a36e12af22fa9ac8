"""Language of texts by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequery.llm.folds import hash_rank, send
from tilequery.llm.text import blocks, text_buffers
from tilequery.session import materialize

#: labelled texts each language's model is fitted on, at most; as many again calibrate the scores
MAX_TEXTS = 4000
ORDER = 4
UNKNOWN = "und"


def letter_table(frequent: list[str]) -> np.ndarray:
    """Code of every character: 0 for what is no letter, 1.. for the frequent letters in either case, 255 for other letters."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            out[c] = 255
    for i, c in enumerate(frequent[:254]):
        for form in {c, c.upper()}:
            if len(form) == 1:
                out[ord(form)] = i + 1
    return out


class Grams:
    """Four-letter codes of a block: every letter, and every first gap after one, with the three signs before it."""

    def __init__(self, texts: pa.Array, table: np.ndarray):
        raw, at = text_buffers(texts)
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        at = lead[at]
        c = table[points]
        first = np.zeros(len(c) + 1, bool)
        first[at] = True
        keep = c > 0
        keep[1:] |= c[:-1] > 0
        keep &= ~(first[: len(c)] & (c == 0))
        owner = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
        c = c[keep].astype(np.uint32)
        n = len(c)
        place = np.arange(n) - np.searchsorted(owner, owner)  # how many signs of its text stand before
        code = c.copy()
        for k in range(1, ORDER):
            before = np.zeros(n, np.uint32)
            before[k:] = c[:-k] if n > k else before[k:]
            before[place < k] = 0
            code |= before << np.uint32(8 * k)
        self.code, self.owner = code, owner
        self.letters = np.bincount(owner[c > 0], minlength=len(texts))
        self.signs = np.bincount(owner, minlength=len(texts))


class KneserNey:
    """Interpolated Kneser-Ney models of order 4 over letter codes, one column per language.

    Per order: sorted n-grams with their discounted probability, sorted contexts with the weight of the next lower order.
    """

    def __init__(self, languages: list[str], table: np.ndarray, language: np.ndarray, code: np.ndarray, count: np.ndarray):
        self.languages, self.table = languages, table
        k = len(languages)
        self.grams, self.contexts = [], []
        size = 256
        for order in range(ORDER, 0, -1):
            keys, at = np.unique(code, return_inverse=True)
            table_ = np.zeros((len(keys), k))
            table_[at, language] = count
            ctx, ctx_at = np.unique(self._context(keys), return_inverse=True)
            total, kinds = np.zeros((len(ctx), k)), np.zeros((len(ctx), k))
            np.add.at(total, ctx_at, table_)
            np.add.at(kinds, ctx_at, table_ > 0)
            ones, twos = (table_ == 1).sum(0), (table_ == 2).sum(0)
            discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
            share = np.maximum(table_ - discount, 0) / np.maximum(total[ctx_at], 1)
            rest = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            self.grams.append((keys, share.astype(np.float32)))
            self.contexts.append((ctx, rest.astype(np.float32)))
            # continuation counts: in how many contexts the gram without its first sign is seen
            mask = np.uint32((1 << (8 * (order - 1))) - 1) if order > 1 else np.uint32(0)
            rows, cols = np.nonzero(table_)
            pair = np.unique((keys[rows] & mask).astype(np.uint64) * np.uint64(k) + cols.astype(np.uint64), return_counts=True)
            code, language, count = (pair[0] // np.uint64(k)).astype(np.uint32), (pair[0] % np.uint64(k)).astype(np.int64), pair[1].astype(float)
        self.base = 1.0 / size

    @staticmethod
    def _context(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint32(8)  # the last sign is in the lowest byte

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        have, values = table
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where((have[at] == keys)[:, None], values[at], np.float32(default))

    def logs(self, code: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each code's last sign after the three before it, per language."""
        p = np.full((len(code), len(self.languages)), self.base, np.float32)
        for order in range(1, ORDER + 1):
            key = code & np.uint32((1 << (8 * order)) - 1) if order < 4 else code
            i = ORDER - order
            p = self._get(self.grams[i], key, 0.0) + self._get(self.contexts[i], self._context(key), 1.0) * p
        return np.log(p)


class Scorer:
    """Cross-entropies of blocks; logs of grams seen lately are kept in a table addressed by their hash."""

    def __init__(self, model: KneserNey, slots: int = 1 << 21):
        self.model, self.mask = model, np.uint32(slots - 1)
        self.keys = np.zeros(slots, np.uint32)
        self.filled = np.zeros(slots, bool)
        self.values = np.zeros((slots, len(model.languages)), np.float32)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean negative log-probability per sign [texts, languages], letters and signs per text."""
        g = Grams(texts, self.model.table)
        slot = ((g.code * np.uint32(0x9E3779B1)) >> np.uint32(9)) & self.mask
        missing = ~self.filled[slot] | (self.keys[slot] != g.code)
        sums = np.zeros((len(texts), len(self.model.languages)))
        if missing.any():
            new, back = np.unique(g.code[missing], return_inverse=True)
            logs = self.model.logs(new)
            at = ((new * np.uint32(0x9E3779B1)) >> np.uint32(9)) & self.mask
            self.keys[at], self.filled[at], self.values[at] = new, True, logs
            self.keys[at] = new  # of two codes in one slot the last stays, with its own logs
            good = self.keys[slot] == g.code
            late = np.flatnonzero(~good)
            values = self.values[slot]
            if len(late):
                values[late] = logs[np.searchsorted(new, g.code[late])] if np.isin(g.code[late], new).all() else self.model.logs(g.code[late])
        else:
            values = self.values[slot]
        some = np.flatnonzero(g.signs)  # signs stand in order of their texts
        if len(some):
            sums[some] = np.add.reduceat(values, (np.cumsum(g.signs) - g.signs)[some], axis=0, dtype=np.float64)
        return -sums / np.maximum(g.signs, 1)[:, None], g.letters, g.signs


class Identifier:
    """Models, temperature of the scores and the cross-entropy from which each language is rejected."""

    def __init__(self, model: KneserNey, sharpness: float, limits: np.ndarray):
        self.model, self.sharpness, self.limits = model, sharpness, limits

    def predict(self, docs: DataFrame, reject: bool = True) -> DataFrame:
        """``docs`` (only doc_id and text are read) with ``lang_pred`` and ``score``.

        The language with the lowest cross-entropy per sign wins; ``score`` is its share of the calibrated odds. Null texts
        and texts without a letter are ``und`` with score 0, and with ``reject`` so are texts whose cross-entropy lies beyond what
        the language's own calibration texts reach.
        """
        sent = send(docs.sparkSession, self)

        def run(batches):
            me = sent()
            scorer = Scorer(me.model)
            names = np.array([*me.model.languages, UNKNOWN], object)
            for batch in batches:
                for part in blocks(batch):
                    h, letters, _ = scorer.entropies(part.column("text"))
                    best = h.argmin(1)
                    odds = np.exp(-me.sharpness * (h - h.min(1, keepdims=True)))
                    score = 1 / odds.sum(1)
                    out = letters == 0
                    if reject:
                        out |= h[np.arange(len(h)), best] > me.limits[best]
                    best[out] = len(me.model.languages)
                    score[out] = 0.0
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fit(texts: DataFrame, max_texts: int = MAX_TEXTS) -> Identifier | None:
    """Learn from ``doc_id, text, lang``; null languages and texts are left out, None where nothing is left.

    Each language lends the ``2 * max_texts`` texts with the smallest hash of doc_id; alternate ones are counted and calibrate.
    """
    known = texts.filter("lang is not null and text is not null").select("doc_id", "lang", hash_rank("doc_id").alias("_u"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    # a little more than the share wanted of each language is left to rank, however large the language is
    few = known.join(sizes, "lang").filter(F.col("_u") * F.col("_n") <= 2.4 * max_texts)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id"))
    chosen = few.withColumn("_r", rank).filter(F.col("_r") <= 2 * max_texts)
    sample = materialize(
        texts.join(F.broadcast(chosen.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), "_r")), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l"))).select("text", "lang", "_r")
    )
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    signs = sample.select(F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(1000).collect()
    table = letter_table([r["c"] for r in signs if len(r["c"]) == 1 and unicodedata.category(r["c"])[0] == "L"])
    sent = sample.sparkSession.sparkContext.broadcast((table, languages))

    def count(batches):
        table, languages = sent.value
        for batch in batches:
            for part in blocks(batch):
                g = Grams(part.column("text"), table)
                lang = np.array([languages.index(x) for x in part.column("lang").to_pylist()], np.uint64)
                keys, n = np.unique((lang[g.owner] << np.uint64(32)) | g.code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["k", "n"])

    odd = sample.filter("_r % 2 = 1")
    counts = odd.select("text", "lang").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toPandas()
    k = counts["k"].to_numpy(np.int64)
    model = KneserNey(languages, table, k >> 32, (k & 0xFFFFFFFF).astype(np.uint32), counts["n"].to_numpy(float))
    held = send(sample.sparkSession, model)

    def measure(batches):
        scorer = Scorer(held())
        for batch in batches:
            for part in blocks(batch):
                h, letters, _ = scorer.entropies(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(letters)], ["lang", "h", "n"])

    even = sample.filter("_r % 2 = 0").select("text", "lang").mapInArrow(measure, "lang string, h array<double>, n long").filter("n > 0").toPandas()
    sharpness, limits = 20.0, np.full(len(languages), np.inf)
    if len(even):
        h = np.stack(even["h"].to_numpy())
        truth = np.array([languages.index(x) for x in even["lang"]])
        own = h[np.arange(len(h)), truth]
        losses = [(np.mean(np.log(np.exp(-s * (h - own[:, None])).clip(max=1e30).sum(1))), s) for s in (1, 2, 4, 8, 16, 32, 64)]
        sharpness = float(min(losses)[1])
        for i in range(len(languages)):
            if (truth == i).any():
                limits[i] = own[truth == i].mean() + 6 * own[truth == i].std() + 0.5
    return Identifier(model, sharpness, limits)
