"""A hierarchical Pitman-Yor language model: Chinese-restaurant seating sampled by Gibbs over shards of words."""

from __future__ import annotations

import ctypes
import gc
import time

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.folds import send
from tilequery.llm.text import Words, blocks, mix
from tilequery.session import discard, scratch_path, shared_dir

#: contexts that the number of a cell, word * span + context, has room for where nothing else is said
CONTEXTS = 1 << 14
#: parts into which the contexts of a very frequent word are dealt, and the share of all tokens from which a word is one
HOT_PARTS, HOT_SHARE = 64, 0.0005
#: bytes of text per shard, and read at once for the hot words
SHARD_BYTES, SENT_BYTES = 8 << 20, 2 << 20
#: bytes of text of a block, whose distinct (word, context) are counted and asked for once
BLOCK_BYTES = 4 << 20
#: sweeps that are thrown away, and sweeps whose predictions are averaged
BURN_IN, SAMPLES = 2, 3
#: probability of a new type, as against a known one, at the bottom of the hierarchy
NEW_TYPE = 0.5
#: discounts are estimated (see ``_discount``), concentrations are fixed
CONCENTRATION = 1.0

_END = np.uint64(0x5851F42D4C957F2D)


class Tokens:
    """Tokens of a block: every text's words (A-Z lower-cased) and its end; ``word`` hash and ``context`` (hash of the token before) of each, their number in each text."""

    def __init__(self, texts: pa.Array):
        found = [(w.hashes(), w.counts()) for w in (Words(part.column(0), lower=True) for part in blocks(pa.RecordBatch.from_arrays([texts], ["text"])))]
        h, n = (np.concatenate([np.zeros(0, kind), *(f[k] for f in found)]) for k, kind in enumerate((np.uint64, np.int64)))
        docs = len(n)
        last = np.cumsum(n + 1) - 1
        self.word = np.empty(len(h) + docs, np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner] = h
        self.word[last] = _END
        self.n = n + 1

    @property
    def context(self) -> np.ndarray:
        return np.roll(self.word, 1)  # before the first word of a text stands an end: of the text before or, for the first one, of the last


def _route(word: np.ndarray, context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What decides a token's shard: its word, for a very frequent word also a part of the contexts."""
    out = word.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
        busy = hot[at] == word
        out[busy] = mix(word[busy] + (context[busy] % np.uint64(HOT_PARTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed, all first bytes of an array before all second ones."""
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return zstandard.compress(b"".join(np.int64(a.nbytes).tobytes() + planes(a) for a in arrays), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n, at + 8).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 8 + n
    return out


def _steps(hashes: np.ndarray) -> np.ndarray:
    """From one hash to the next, of hashes in order; their running sums are the hashes."""
    return np.diff(hashes, prepend=hashes.dtype.type(0))


def _hot_words(docs: DataFrame) -> np.ndarray:
    """Words (and the end) that are ``HOT_SHARE`` of the tokens of some texts or more; they only decide where tokens are counted."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, size=SENT_BYTES):
                t = Tokens(part.column("text"))
                keys, n = np.unique(t.word, return_counts=True)
                big = n >= HOT_SHARE * len(t.word)
                yield pa.RecordBatch.from_arrays([pa.array(keys[big].view(np.int64)), pa.array(n[big])], ["w", "n"])

    some = docs.filter(F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(64)) == 0).select("text")
    found = some.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(2000).collect()
    return np.unique(np.array([r["w"] for r in found] + [int(_END.view(np.int64))], np.int64).view(np.uint64))


_BLOCKS = "block long, blob binary, docs array<long>, n array<int>, part string"


def _full(batches):
    """Batches put together until they hold ``BLOCK_BYTES`` of text, larger ones cut."""
    waiting, size = [], 0
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in batches:
        for part in blocks(batch, size=BLOCK_BYTES):
            more = part.column("text").nbytes
            if waiting and size + more > BLOCK_BYTES:
                yield whole(waiting)
                waiting, size = [], 0
            waiting.append(part)
            size += more
    if waiting:
        yield whole(waiting)


def _give_back() -> None:
    """Freed memory goes back to the system: workers stay, and others run beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def token_blocks(docs: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """Per block of texts one row with their ids, numbers of tokens and every token's place among the block's distinct (word, context), and one row with
    these, their training counts and the shards that hold them, packed (see ``asked_of``). ``part`` tells the first (texts) from the others (cells).

    ``docs``: doc_id, text, learn (whether counts are taken from the text).
    """
    sent, names = docs.sparkSession.sparkContext.broadcast(hot), ["block", "blob", "docs", "n", "part"]

    def cut(batches):
        task = TaskContext.get().partitionId()
        for at, part in enumerate(_full(batches)):
            t = Tokens(part.column("text"))
            many, learn = t.n, part.column("learn").to_numpy(zero_copy_only=False)
            vocabulary, word = np.unique(t.word, return_inverse=True)
            del t
            word = word * len(vocabulary) + np.roll(word, 1)
            cells, own = np.unique(word, return_inverse=True)
            n = np.bincount(own, np.repeat(learn, many), minlength=len(cells)).astype(np.uint32)
            word, context = np.divmod(cells, len(vocabulary))
            key = _route(vocabulary[word], vocabulary[context], sent.value)
            shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")  # by shard, word and context
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            asked = _pack(_steps(vocabulary), *(np.diff(v[order], prepend=0).astype(np.uint32) for v in (shard, word)), context[order].astype(np.uint32), n[order])
            for what, blob, ids, counts in (("texts", _pack(place[own]), part.column("doc_id").to_pylist(), many), ("cells", asked, None, None)):
                columns = [pa.array([(task << 32) + at]), pa.array([blob], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([what])]
                yield pa.RecordBatch.from_arrays(columns, names)
        _give_back()

    return docs.select("doc_id", "text", "learn").mapInArrow(cut, _BLOCKS)


def asked_of(block: int, blob: bytes):
    """``(shard, (block, what it is asked for))`` of a block's cells: its words and the number of cells of each, contexts, the place of each cell's context among these and its training count."""
    vocabulary, shard, word, context, n = _unpack(blob, "<u8", "<u4", "<u4", "<u4", "<u4")
    vocabulary = np.cumsum(vocabulary)
    shard, word = (np.cumsum(v, dtype=np.uint32) for v in (shard, word))  # steps back have wrapped around
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[: len(shard)]
    for x, y in zip(first.tolist(), np.append(first[1:], len(shard)).tolist()):
        w = word[x:y]
        begin = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        known, c = np.unique(context[x:y], return_inverse=True)
        yield int(shard[x]), (block, _pack(_steps(vocabulary[w[begin]]), np.diff(np.append(begin, y - x)).astype(np.uint32), _steps(vocabulary[known]), c.astype(np.uint32), n[x:y]))


def _own(shard: int) -> int:
    return shard


def _merged(records) -> dict[int, dict]:
    """What a partition's records say of each shard (or home), put together."""
    out: dict[int, dict] = {}
    for key, part in records:
        out.setdefault(key, {}).update(part)
    return out


def _arrays(part: dict, kind: str) -> np.ndarray:
    """The arrays ``(kind, home)`` of a shard, in the order of its contexts."""
    return np.concatenate([_unpack(part[k], "<u4")[0] for k in sorted(k for k in part if isinstance(k, tuple) and k[0] == kind)])


def _home(contexts: np.ndarray, homes: int) -> np.ndarray:
    """Where the totals of a context are added up; contexts in order come to homes in order."""
    return ((contexts >> np.uint64(32)) * np.uint64(homes) >> np.uint64(32)).astype(np.int64)


def token_shards(cells: DataFrame, shards: int) -> RDD:
    """``(shard, parts)``, one record a partition: its ``words`` and ``contexts`` (hashes in order), training ``counts`` per cell, and which cells each block ``asked``
    for, packed. A cell is its word's place times the number of contexts, plus its context's place."""

    def gather(records):
        found: dict[int, list] = {}
        for shard, asking in records:
            found.setdefault(shard, []).append(asking)
        for shard, asking in found.items():
            words, sizes, names, at, counts, lengths, behind = [], [], [], [], [], [], 0
            for _, blob in asking:
                w, m, k, c, n = _unpack(blob, "<u8", "<u4", "<u8", "<u4", "<u4")
                words.append(np.cumsum(w))
                sizes.append(m)
                names.append(np.cumsum(k))
                at.append(c + np.int64(behind))
                counts.append(n)
                lengths.append(len(c))
                behind += len(k)
            words = np.concatenate(words)
            vocabulary = np.unique(words)
            contexts, named = np.unique(np.concatenate(names), return_inverse=True)
            cells = np.repeat(np.searchsorted(vocabulary, words) * np.int64(len(contexts)), np.concatenate(sizes)) + named[np.concatenate(at)]
            every, own = np.unique(cells, return_inverse=True)
            n = np.bincount(own, np.concatenate(counts), minlength=len(every)).astype(np.int64)
            lengths = np.array(lengths, np.int64)
            steps = np.diff(own, prepend=0)  # from one asked cell to the next, in each block from 0
            begin = (np.cumsum(lengths) - lengths)[lengths > 0]
            steps[begin] = own[begin]
            asked = _pack(np.diff(every, prepend=0), np.array([block for block, _ in asking], np.int64), lengths, steps.astype(np.uint32))
            yield shard, {"words": vocabulary.tobytes(), "contexts": contexts.tobytes(), "counts": _pack(every[n > 0], n[n > 0]), "asked": asked}
            _give_back()

    asking = cells.select("block", "blob").rdd.flatMap(lambda r: asked_of(r["block"], bytes(r["blob"])))
    return asking.partitionBy(shards, _own).mapPartitions(gather, True)


def _cut_off(rdd: RDD) -> RDD:
    """Checkpointed; nothing holds on to what it came from, so that Spark may clear away its shuffle."""
    rdd.checkpoint()
    rdd._jrdd.count()
    out = RDD(rdd._jrdd, rdd.ctx, rdd._jrdd_deserializer)
    out.partitioner, out.is_checkpointed = rdd.partitioner, True
    return out


class Totals:
    """Customers and tables of every context, added up over the shards that hold cells of it.

    A context has a home, found from its hash. Once every shard names its contexts there, each home keeps which of its contexts a shard has, and
    sends back their customers and cells. After a sweep only tables beyond one per cell travel, as arrays in these orders.
    """

    def __init__(self, held: RDD, shards: int):
        self.shards = shards

        def named(record):
            shard, part = record
            contexts = np.frombuffer(part["contexts"], np.uint64)
            cells, n = _unpack(part["counts"], "<i8", "<i8")
            c = cells % max(1, len(contexts))
            customers, kept = np.bincount(c, n, minlength=len(contexts)).astype(np.uint32), np.bincount(c, minlength=len(contexts)).astype(np.uint32)
            return [(home, {shard: _pack(_steps(contexts[x:y]), customers[x:y], kept[x:y])}) for home, x, y in _stretches(contexts, shards)]

        def enrolled(records):
            for home, parts in _merged(records).items():
                each = {shard: _unpack(parts[shard], "<u8", "<u4", "<u4") for shard in sorted(parts)}
                every, at = np.unique(np.concatenate([np.cumsum(e[0]) for e in each.values()]), return_inverse=True)
                sums = [np.bincount(at, np.concatenate([e[k] for e in each.values()]), minlength=len(every)).astype(np.uint32) for k in (1, 2)]
                ends = np.cumsum([len(e[0]) for e in each.values()]).tolist()
                for shard, x, y in zip(each, [0, *ends], ends):
                    yield home, {shard: (_pack(np.diff(at[x:y], prepend=0).astype(np.uint32)), *(_pack(v[at[x:y]]) for v in sums))}

        self.homes = held.flatMap(named).partitionBy(shards, _own).mapPartitions(enrolled, True).persist(StorageLevel.DISK_ONLY)
        back = self.homes.flatMap(lambda e: [(shard, {("customers", e[0]): v[1], ("cells", e[0]): v[2]}) for shard, v in e[1].items()])
        self.fixed = back.partitionBy(shards, _own)

    def added(self, sent: RDD, name: str) -> RDD:
        """``(shard, {(name, home): tables beyond one per cell})`` over all shards, of what each home was sent: ``(home, {("beyond", shard): tables})``."""

        def add(records):
            for home, parts in _merged(records).items():
                shards = [k for k in parts if not isinstance(k, tuple)]
                at = {shard: np.cumsum(_unpack(parts[shard][0], "<u4")[0], dtype=np.int64) for shard in shards}
                if not at:
                    continue
                sums = np.zeros(1 + max(int(v.max()) for v in at.values()), np.int64)
                for shard, places in at.items():
                    sums[places] += _unpack(parts["beyond", shard], "<u4")[0]  # a shard has a context once
                for shard, places in at.items():
                    yield shard, {(name, home): _pack(sums[places].astype(np.uint32))}

        return self.homes.union(sent).mapPartitions(add).partitionBy(self.shards, _own)


def _stretches(contexts: np.ndarray, homes: int):
    """``home, first, last + 1`` of the contexts (in order) of each home."""
    home = _home(contexts, homes)
    first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])[: len(home)]
    return zip(home[first].tolist(), first.tolist(), np.append(first[1:], len(home)).tolist())


def seat(customers: np.ndarray, inviting: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes after all their customers have sat down anew.

    Customer i of a dish opens a table in proportion to ``inviting`` (concentration and discount times tables of the restaurant, times the
    parent's probability of the dish) or joins one in proportion to i - discount * tables. The first 256 customers of a
    dish sit one by one, later ones in groups of a sixty-fourth of those seated.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        group = 1 if seated < 256 else seated // 64
        n = np.minimum(group, customers[live] - seated)
        open_ = inviting[live] / (inviting[live] + seated - discount * tables[live])
        if group == 1:
            tables[live] += rng.random(len(live)) < open_
        else:
            tables[live] += rng.binomial(n, np.clip(open_, 0, 1))
        seated += group
        live = live[customers[live] > seated]
    return np.minimum(tables, customers)


class State:
    """What shards go by during a sweep: sizes, discounts, customers and tables of the root and of the frequent words that are spread over
    shards, the same for all and of fixed size, so they travel with the tasks; and those of a shard's own contexts (see ``within``)."""

    def __init__(self, vocabulary: int, discounts: tuple[float, float], customers: np.ndarray, tables: np.ndarray, root_tables: float, hot: np.ndarray, hot_customers: np.ndarray, root_customers: float | None = None):
        self.vocabulary, self.discounts, self.customers, self.tables = vocabulary, discounts, customers, tables
        self.root_customers, self.root_tables = tables.sum() if root_customers is None else root_customers, root_tables
        self.hot, self.hot_customers = hot, hot_customers

    def within(self, customers: np.ndarray, tables: np.ndarray) -> State:
        """The same for a shard with these totals of its contexts."""
        return State(self.vocabulary, self.discounts, customers, tables, self.root_tables, self.hot, self.hot_customers, self.root_customers)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of known words in the root restaurant."""
        d = self.discounts[0]
        base = (1 - NEW_TYPE) / max(1, self.vocabulary)
        return (np.maximum(customers - d * tables, 0) + (CONCENTRATION + d * self.root_tables) * base) / (CONCENTRATION + self.root_customers)

    def unknown(self) -> float:
        """Probability, in the root restaurant, of a word that training has not seen."""
        return (CONCENTRATION + self.discounts[0] * self.root_tables) * NEW_TYPE / (CONCENTRATION + self.root_customers)


def _hot_at(words: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hot):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    mine = np.flatnonzero(hot[at] == words)
    return mine, at[mine]


def _sweep(state: State, words: np.ndarray, cells: np.ndarray, counts: np.ndarray, seed: tuple[int, int], span: int = CONTEXTS):
    """One Gibbs sweep of a shard: tables of each (word, context), and the root's customers (of this shard) and tables of each word."""
    rng = np.random.default_rng(seed)
    word, context = cells // span, cells % span
    # the root as the last sweep left it: one table per cell to begin with, then redrawn below
    guess = np.bincount(word, minlength=len(words)).astype(float)
    mine, at = _hot_at(words, state.hot)
    guess[mine] = state.hot_customers[at]
    parent = state.root(guess, np.minimum(guess, 1))
    inviting = (CONCENTRATION + state.discounts[1] * state.tables[context]) * parent[word]
    tables = seat(counts, inviting, state.discounts[1], rng)
    customers = np.bincount(word, tables, minlength=len(words))
    own = customers.copy()
    customers[mine] = np.maximum(state.hot_customers[at], own[mine])
    base = (CONCENTRATION + state.discounts[0] * state.root_tables) * (1 - NEW_TYPE) / max(1, state.vocabulary)
    root_tables = seat(customers.astype(np.int64), np.full(len(words), base), state.discounts[0], rng)
    return tables, own, root_tables


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1.0), 0.05, 0.95))


def _spread(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Sums over shards, of places and their values."""
    out = np.zeros(size)
    for at, values in found:
        out[at] += values
    return out


def score_texts(docs: DataFrame, learn, shards: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs`` (doc_id, text).

    Tokens are words (A-Z lower-cased) and one end per text; ``learn`` (a column) says which texts are counted. ``score`` is the
    log10 probability of the text: the restaurant of each token's context (the word before it) backs off to the root restaurant
    over all words, and that to known words evenly or a new type. Tables are sampled sweep by sweep; the probabilities of the last
    ``SAMPLES`` sweeps are averaged. ``base_score`` is the add-one unigram score, ``n_known`` the tokens seen in training.

    Words are dealt to shards, very frequent ones by (word, context); within a sweep a shard takes the totals of contexts and root from the
    sweep before. Those of contexts are added up in shards of contexts (see ``Totals``), only the root's pass the driver. A block of texts asks
    each shard once for its distinct (word, context) and adds up the answers; nothing travels by document and shard. A null text is empty (one end). Equal rows
    get equal scores. Without training texts every token is unknown and N is 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(1, -(-total // SHARD_BYTES))
    hot = _hot_words(rows)
    path = scratch_path(spark)
    token_blocks(rows, shards, hot).write.partitionBy("part").parquet(path)
    stored = lambda part: spark.read.schema(_BLOCKS).parquet(path).filter(F.col("part") == part)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    held = _cut_off(token_shards(stored("cells"), shards))
    kinds = ("<i8", "<i8")

    def measure(record):
        part = record[1]
        words, span = np.frombuffer(part["words"], np.uint64), len(part["contexts"]) // 8
        cells, n = _unpack(part["counts"], *kinds)
        per, shared = (np.bincount(cells // span, v, minlength=len(words)) for v in (n, None))
        mine, at = _hot_at(words, hot)
        alone = np.ones(len(words), bool)
        alone[mine] = False
        return (at, per[mine]), (at, shared[mine]), np.array([n.sum(), (alone & (per > 0)).sum(), (n == 1).sum(), (n == 2).sum(), (shared == 1).sum(), (shared == 2).sum(), len(n)])

    seen = held.map(measure).collect()
    discard(spark, f"{path}/part=cells")
    for _ in range(2):  # else the shuffle behind the shards would stay as long as the driver has memory to spare
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
    totals = Totals(held, shards)
    figures = sum((e[2] for e in seen), np.zeros(7))
    hot_counts, hot_customers = (_spread([e[k] for e in seen], len(hot)) for k in range(2))
    n_train, vocabulary = int(figures[0]), int(figures[1] + (hot_counts > 0).sum())
    discounts = (_discount(figures[4], figures[5]), _discount(figures[2], figures[3]))
    none = np.zeros(0)
    state = State(vocabulary, discounts, none, none, float(vocabulary), hot, hot_customers, float(figures[6]))

    def swept(state: State, at: int, beyond: RDD | None) -> RDD:
        """What shards send after one more sweep: their contexts' tables beyond one per cell, by home, and to the first one what the driver adds up."""
        shared, later = send(spark, state), beyond is not None

        def run(records):
            for shard, part in _merged(records).items():
                words, contexts = (np.frombuffer(part[k], np.uint64) for k in ("words", "contexts"))
                cells, n = _unpack(part["counts"], *kinds)
                tables = _arrays(part, "cells").astype(float)
                if later:
                    tables += _arrays(part, at)
                state = shared().within(_arrays(part, "customers").astype(float), tables)
                tables, own, root = _sweep(state, words, cells, n, (at, shard), len(contexts))
                mine, hot_at = _hot_at(words, state.hot)
                alone = np.ones(len(words), bool)
                alone[mine] = False
                more = np.bincount(cells % len(contexts), tables - 1, minlength=len(contexts)).astype(np.uint32)
                yield 0, {("figures", shard): ((hot_at, own[mine]), root[alone].sum(), tables.sum())}
                for home, x, y in _stretches(contexts, shards):
                    yield home, {("beyond", shard): _pack(more[x:y])}

        whole = held.union(totals.fixed)
        return (whole.union(beyond) if later else whole).mapPartitions(run).partitionBy(shards, _own)

    states, beyond = [state], [None]  # before each sweep and after the last one
    for at in range(BURN_IN + SAMPLES):
        now = swept(state, at, beyond[-1])
        figured = lambda records: [v for _, part in records for (kind, _), v in part.items() if kind == "figures"]
        found = spark.sparkContext.runJob(now, figured, [0])
        hot_tables = _spread([e[0] for e in found], len(hot))
        root_tables = sum(e[1] for e in found) + (hot_tables > 0).sum()
        state = State(vocabulary, discounts, none, none, float(root_tables), hot, hot_tables, float(sum(e[2] for e in found)))
        states.append(state)
        beyond.append(totals.added(now, at + 1))
    everything = send(spark, (states, hot_counts))

    def row(records):
        for shard, part in _merged(records).items():
            tables = [_pack(_arrays(part, at)) if at else None for at in range(BURN_IN, len(states))]
            yield shard, part["words"], part["counts"], part["asked"], _pack(_arrays(part, "customers"), _arrays(part, "cells")), tables

    def predict(batches):
        states, hot_counts = everything()
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                cells, n = _unpack(batch.column("counts")[i].as_py(), *kinds)
                every, asking, lengths, steps = _unpack(batch.column("asked")[i].as_py(), "<i8", "<i8", "<i8", "<u4")
                every = np.cumsum(every)
                customers, one = (v.astype(float) for v in _unpack(batch.column("contexts")[i].as_py(), "<u4", "<u4"))
                tables_of = [one if blob is None else one + _unpack(blob, "<u4")[0] for blob in batch.column("tables")[i].as_py()]
                span = len(customers)
                per = np.bincount(cells // span, n, minlength=len(words))
                mine, at = _hot_at(words, hot)
                per[mine] = hot_counts[at]
                place = np.minimum(np.searchsorted(cells, every), max(0, len(cells) - 1))
                has = cells[place] == every if len(cells) else np.zeros(len(every), bool)
                place, (word, context) = place[has], np.divmod(every, span)
                p = np.zeros(len(every))
                for k in range(SAMPLES):
                    before, after = (states[BURN_IN + j].within(customers, tables_of[j]) for j in (k, k + 1))
                    # drawn again as in the sweep: the same state and seed give the same tables
                    tables, dishes, root_tables = _sweep(before, words, cells, n, (BURN_IN + k, batch.column("shard")[i].as_py()), span)
                    dishes[mine] = after.hot_customers[at]
                    root_tables[mine] = np.minimum(dishes[mine], 1)
                    root = np.where(per > 0, after.root(dishes, root_tables), after.unknown())
                    now = (CONCENTRATION + discounts[1] * after.tables[context]) * root[word]
                    now[has] += (n - discounts[1] * tables)[place]
                    p += now / (CONCENTRATION + customers[context])
                p = (p / SAMPLES).astype(np.float32)
                ends = np.cumsum(lengths)
                for block, x, y in zip(asking.tolist(), (ends - lengths).tolist(), ends.tolist()):
                    own = np.cumsum(steps[x:y], dtype=np.int64)
                    w = word[own]
                    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    blob = _pack(np.diff(np.append(first, y - x)).astype(np.uint32), per[w[first]].astype(np.int64), p[own])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([batch.column("shard")[i].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["block", "shard", "blob"])
        _give_back()

    def answered(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each asked cell, and its word's count in training."""
        many, per, p = _unpack(blob, "<u4", "<i8", "<f4")
        return np.log10(p.astype(np.float64)), np.repeat(per, many)

    def add_up(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")  # the block itself, then answers in the order of its cells
        tokens = _unpack(table.column("blob")[0].as_py(), "<u4")[0]
        answers = [answered(blob.as_py()) for blob in table.column("blob")[1:]]
        logs, per = (np.concatenate([a[k] for a in answers]) for k in range(2))
        many = table.column("n")[0].values.to_numpy()
        doc = np.repeat(np.arange(len(many)), many)
        total = lambda v: pa.array(np.bincount(doc, v[tokens], minlength=len(many)))
        return pa.table([table.column("docs")[0].values, pa.array(many, pa.int64()), total(per > 0).cast(pa.int64()), total(np.log10(per + 1)), total(logs)], ["doc_id", "n", "known", "base", "score"])

    whole = held.union(totals.fixed)
    for tables in beyond[BURN_IN:]:
        whole = whole if tables is None else whole.union(tables)
    schema = "shard int, words binary, counts binary, asked binary, contexts binary, tables array<binary>"
    answers = spark.createDataFrame(whole.mapPartitions(row, True), schema, verifySchema=False).mapInArrow(predict, "block long, shard int, blob binary")
    both = stored("texts").select("block", F.lit(-1).alias("shard"), "blob", "docs", "n").unionByName(answers, allowMissingColumns=True).repartition(shards, "block")
    out = both.groupBy("block").applyInArrow(add_up, "doc_id long, n long, known long, base double, score double")
    log_all = float(np.log10(n_train + vocabulary + 1))
    return out.select(
        "doc_id", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(log_all)).alias("base_score"), "score",
    )
