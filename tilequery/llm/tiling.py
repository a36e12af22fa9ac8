"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.text import NO_WORD, Words, blocks, mix
from tilequery.llm.toxicity import Lookup
from tilequery.session import materialize

#: words of a seed, and so of the shortest tile
SEED_WORDS = 5
#: words of benchmark text that may travel with the tasks (16 bytes each); a larger benchmark is joined by shuffle
SHIPPED_WORDS = 2_000_000
#: share of an item's words that tiles must cover
COVERAGE = 0.6


def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin fingerprint of every window of ``width`` word hashes (prefix sums of a polynomial, one multiplication per window)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(base) + words[k : k + n]
    return mix(h)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in doc, place in item, words) of non-overlapping tiles.

    Windows of ``least`` words with equal fingerprints are grown to maximal matches. The longest match is marked first (ties:
    the earlier place in the document, then in the item); a match that has lost words to earlier tiles goes back with
    what is left of it, until no unmarked match of ``least`` words remains.
    """
    fd, fi = _rolling(doc, least), _rolling(item, least)
    places: dict[int, list[int]] = {}
    for j, f in enumerate(fi.tolist()):
        places.setdefault(f, []).append(j)
    hits = [(i, j) for i in np.flatnonzero(np.isin(fd, fi)).tolist() for j in places[int(fd[i])]]
    runs: list[tuple[int, int, int]] = []
    open_: dict[int, list[int]] = {}  # diagonal: [start in doc, start in item, last hit]
    for i, j in hits:
        run = open_.get(i - j)
        if run and run[2] == i - 1:
            run[2] = i
        else:
            if run:
                runs.append((run[0], run[1], run[2] - run[0] + least))
            open_[i - j] = [i, j, i]
    runs += [(a, b, z - a + least) for a, b, z in open_.values()]
    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = ~(in_doc[a : a - n] | in_item[b : b - n])
        if free.all():
            in_doc[a : a - n] = True
            in_item[b : b - n] = True
            out.append((a, b, -n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def _words(texts: pa.Array) -> Words:
    return Words(pc.utf8_lower(texts), gaps=NO_WORD)


def _item_words(texts: pa.Array) -> list[np.ndarray]:
    words = _words(texts)
    h = words.hashes()
    return [h[a:b] for a, b in zip(words.doc[:-1], words.doc[1:])]


_SCHEMA = "row long, doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles int, longest int"
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def _report(row, doc_id, doc, item_id, item, least: int, coverage: float):
    found = tiles(doc, item, least)
    covered = sum(n for _, _, n in found)
    if covered and covered >= coverage * len(item):
        return (row, doc_id, item_id, len(item), covered, covered / len(item), len(found), max(n for _, _, n in found))
    return None


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _NAMES)


def _seeds(table: DataFrame, id_: str, least: int) -> DataFrame:
    """``row, id, seed, at``: every seed of every text and where it stands."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                f = [_rolling(w, least) for w in _item_words(part.column("text"))]
                n = [len(x) for x in f]
                flat = np.concatenate(f) if f else np.zeros(0, np.uint64)
                at = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), n)) for c in ("row", "id")], pa.array(flat.view(np.int64)), pa.array(at)], ["row", "id", "seed", "at"]
                )

    return table.select("row", F.coalesce(F.col(id_), F.lit(0)).cast("long").alias("id"), "text").mapInArrow(run, "row long, id long, seed long, at long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = SEED_WORDS, coverage: float = COVERAGE, shipped: int = SHIPPED_WORDS) -> DataFrame:
    """One row per document and benchmark item whose words greedy tiles of the document cover to ``coverage`` or more.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. Words are runs of letters and digits in lower case. Returns row (a hash that tells
    documents' rows apart), doc_id, item_id, item_words, covered, coverage, n_tiles, longest. Reordered passages are
    covered tile by tile; tiles do not overlap on either side.

    Null texts and items of fewer than ``least`` words match nothing; equal items are each reported; rows of one doc_id are
    separate; rows equal in doc_id and text are reported once each.

    A benchmark of at most ``shipped`` words travels with the tasks: a document is tiled where it is read. A larger one is
    joined by seed; pairs whose distinct seeds can reach the coverage get their texts by shuffle.
    """
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null")
    # a word has two bytes with the gap after it
    if (bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= 2 * shipped:
        return _where_read(docs, bench, least, coverage)
    return _by_shuffle(docs, bench, least, coverage)


def _where_read(docs: DataFrame, bench: DataFrame, least: int, coverage: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in bench.collect()])

    def run(batches):
        ids = [r[0] for r in held.value]
        items = _item_words(pa.array([r[1] for r in held.value], pa.string()))
        seeds = [_rolling(w, least) for w in items]
        owner = np.repeat(np.arange(len(items)), [len(s) for s in seeds])
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        owners = np.split(owner[order], first[1:]) if len(keys) else []
        table = Lookup(keys)
        for batch in batches:
            for part in blocks(batch):
                words = _words(part.column("text"))
                h = words.hashes()
                near, what = table.find(_rolling(h, least))
                text = np.searchsorted(words.doc, near, "right") - 1
                inside = near + least <= words.doc[text + 1]
                text, what = text[inside], what[inside]
                cuts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])[: len(text)]
                rows = []
                for a, b in zip(cuts, np.append(cuts[1:], len(text))):
                    i = int(text[a])
                    doc = h[words.doc[i] : words.doc[i + 1]]
                    hit: dict[int, int] = {}
                    for k in np.unique(what[a:b]).tolist():
                        for o in owners[k].tolist():
                            hit[o] = hit.get(o, 0) + 1
                    for o, n in sorted(hit.items()):
                        if n * least >= coverage * len(items[o]):  # n places with a seed cover n * least words at most
                            rows.append(_report(part.column("row")[i].as_py(), part.column("doc_id")[i].as_py(), doc, ids[o], items[o], least, coverage))
                yield _batch([r for r in rows if r])

    return docs.mapInArrow(run, _SCHEMA)


def _by_shuffle(docs: DataFrame, bench: DataFrame, least: int, coverage: float) -> DataFrame:
    items = bench.withColumn("row", F.xxhash64("item_id", "text"))
    own = _seeds(items.dropDuplicates(["row"]), "item_id", least)  # equal items share a row: once here, each again in the last join
    size = own.groupBy("row").agg((F.count("*") + least - 1).alias("words"))
    shared = _seeds(docs, "doc_id", least).select("row", "seed").distinct().join(own.select(F.col("row").alias("item"), "seed", "at"), "seed")
    pairs = shared.groupBy("row", "item").agg(F.countDistinct("at").alias("n"))
    pairs = materialize(pairs.join(size, pairs["item"] == size["row"]).filter(F.col("n") * least >= coverage * F.col("words")).select(pairs["row"], "item"))
    joined = docs.join(pairs, "row").join(items.select(F.col("row").alias("item"), "item_id", F.col("text").alias("item_text")), "item")

    def run(batches):
        for batch in batches:
            for part in blocks(batch):
                found = zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), _item_words(part.column("text")), part.column("item_id").to_pylist(), _item_words(part.column("item_text")))
                rows = [_report(*f, least, coverage) for f in found]
                yield _batch([r for r in rows if r])

    return joined.select("row", "doc_id", "text", "item_id", "item_text").mapInArrow(run, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` reports; columns stay."""
    hits = contaminated(docs.select("doc_id", "text"), benchmark, **options).select(F.col("row").alias("__hit")).distinct()
    kept = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))).join(materialize(hits), F.col("__row") == F.col("__hit"), "left_anti")
    return kept.drop("__row")
