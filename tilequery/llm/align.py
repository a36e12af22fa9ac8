"""Links between the tokens of two tokenizers, as products of token-byte and token-group incidence matrices."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.text import blocks
from tilequery.llm.tokens import ByteBpe, PieceBpe, flatten
from tilequery.session import materialize

#: bytes of text whose links are kept in one row, with one list of their id pairs
BLOCK_BYTES = 8 << 20


class Csr:
    """A sparse 0/1 matrix: the columns of row i are ``cols[at[i]:at[i + 1]]``, ascending."""

    def __init__(self, at: np.ndarray, cols: np.ndarray, width: int):
        self.at, self.cols, self.width = at, cols, width

    @classmethod
    def by_row(cls, rows: np.ndarray, cols: np.ndarray, height: int, width: int) -> Csr:
        """From entries in order of their rows."""
        return cls(np.searchsorted(rows, np.arange(height + 1)), cols, width)

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def transpose(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        return Csr.by_row(self.cols[order], self.rows()[order], self.width, len(self.at) - 1)

    def row_sizes_of_product(self, other: Csr) -> np.ndarray:
        """Terms that row i of ``self @ other`` is summed from: entries of the rows of ``other`` that row i of ``self`` picks."""
        terms = np.concatenate([[0], np.cumsum(np.diff(other.at)[self.cols])])
        return terms[self.at[1:]] - terms[self.at[:-1]]

    def product(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``self @ other`` row by row (Gustavson): row, column and value of its entries, in order.

        Each entry (i, k) of a row adds row k of ``other`` to row i of the result. All rows are expanded at once; terms of
        one cell are summed where they meet, after sorting if they don't stand next to each other yet.
        """
        size = np.diff(other.at)[self.cols]
        first = np.cumsum(size) - size
        cols = other.cols[np.repeat(other.at[self.cols] - first, size) + np.arange(int(size.sum()))]
        cell = np.repeat(self.rows(), size) * np.int64(other.width) + cols
        if len(cell) > 1 and not (cell[1:] >= cell[:-1]).all():
            cell.sort()
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        return cell[new] // other.width, cell[new] % other.width, np.diff(np.append(new, len(cell)))


def _places(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)])


class Aligned:
    """Tokens, groups and links of a block of texts that both tokenizers reproduce.

    ``a``/``b``: ids; ``a_at``/``b_at``: their byte ranges; ``doc_a``/``doc_b``: where each text's tokens begin; ``group_a``/``group_b``: number
    of the group of each token. A group ends where tokens of both sides end, as every text does.
    """

    def __init__(self, a: np.ndarray, n_a: np.ndarray, size_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, size_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.doc_a, self.doc_b = _places(n_a), _places(n_b)
        self.a_at, self.b_at = _places(size_a), _places(size_b)
        n = int(self.a_at[-1])
        end = np.zeros(n + 1, np.uint8)
        end[self.a_at[1:]] = 1
        end[self.b_at[1:]] += 1
        both = np.zeros(n + 1, np.int64)
        np.cumsum(end[1:] == 2, out=both[1:])
        self.group_a, self.group_b = both[self.a_at[:-1]], both[self.b_at[:-1]]
        self.n_groups = int(both[-1])
        self.doc_group = both[self.a_at[self.doc_a]]
        self.bytes = n

    def overlap_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token, B token and common bytes of every pair whose byte ranges overlap: token-byte incidence A times B transposed."""
        a = Csr(self.a_at, np.arange(self.bytes), self.bytes)
        b = Csr(self.b_at, np.arange(self.bytes), self.bytes)
        return a.product(b.transpose())

    def _group_incidence(self) -> tuple[Csr, Csr]:
        a = Csr(np.arange(len(self.a) + 1), self.group_a, self.n_groups)
        b = Csr(np.arange(len(self.b) + 1), self.group_b, self.n_groups)
        return a, b.transpose()

    def shared_group_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token, B token and 1 of every pair in one group: the product of the token-group incidences. Quadratic in a group's tokens."""
        a, b = self._group_incidence()
        return a.product(b)

    def shared_group_counts(self) -> np.ndarray:
        """How many links to tokens of its group each A token has: row sizes of the same product, without its entries."""
        a, b = self._group_incidence()
        return a.row_sizes_of_product(b)

    def group_texts(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        before_a = np.searchsorted(self.group_a, np.arange(self.n_groups + 1))  # A tokens in earlier groups
        before_b = np.searchsorted(self.group_b, np.arange(self.n_groups + 1))
        total = len(self.a) + len(self.b)
        ids, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[np.arange(len(self.a)) + before_b[self.group_a]] = self.a
        ids[np.arange(len(self.b)) + before_a[self.group_b + 1]] = self.b
        sign[before_a[1:] + before_b[:-1] - 1] = ord("|")
        sign[before_a[1:] + before_b[1:] - 1] = ord(";")
        width = len(str(int(ids.max()))) if total else 1
        places = 10 ** np.arange(width - 1, -1, -1)
        digits = np.empty((total, width + 1), np.uint8)
        digits[:, :-1] = ids[:, None] // places % 10 + ord("0")
        digits[:, -1] = sign
        keep = np.ones((total, width + 1), bool)
        keep[:, :-1] = ids[:, None] >= places
        keep[:, -2] = True
        out = digits[keep].tobytes()
        ends = _places(keep.sum(1))[self.doc_a + self.doc_b]
        return [out[x : y - 1] if y > x else b"" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Aligner:
    """Both tokenizers, opened once per task."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteBpe(byte_path, plain=True), PieceBpe(piece_path)

    def align(self, texts: list[str]) -> tuple[np.ndarray, Aligned]:
        """Which texts both tokenizers reproduce byte by byte with a space before them, and those aligned."""
        spaced = [" " + t for t in texts]
        bad = [not t for t in texts]
        a, n_a = flatten(self.a.encode(spaced))
        b, n_b = flatten(self.b.encode(texts))
        raw = [s.encode() for s in spaced]
        want = np.frombuffer(b"".join(raw), np.uint8)
        at = _places(np.fromiter(map(len, raw), np.int64, len(raw)))
        good = ~np.array(bad, bool)
        for ids, n, pieces in ((a, n_a, self.a.pieces), (b, n_b, self.b.pieces)):
            have = pieces.bytes(ids)
            ends = _places(pieces.size[ids])[_places(n)]
            if len(have) == len(want) and (ends == at).all():
                wrong = np.flatnonzero(have != want)
                good[np.searchsorted(at, wrong, "right") - 1] = False
            else:  # some text differs in length
                for i in np.flatnonzero(good).tolist():
                    good[i] = have[ends[i] : ends[i + 1]].tobytes() == raw[i]
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        return good, Aligned(a, n_a, self.a.pieces.size[a], b, n_b, self.b.pieces.size[b])


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(x.astype(kind).tobytes(), 1)


def _open(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


_LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


class _Block:
    """What is kept of some megabytes of text: a row per text and its distinct id pairs with how many of its links have them."""

    def __init__(self):
        self.size, self.n = 0, 0
        self.ids: list = []
        self.shas: list = []
        self.figures: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: list, al: Aligned, vocabulary_b: int) -> None:
        a, b, _ = al.overlap_links()
        doc = np.searchsorted(al.doc_a, a, "right") - 1
        pair = al.a[a].astype(np.int64) * vocabulary_b + al.b[b]
        docs = len(al.n_a)
        shared = _places(al.shared_group_counts())[al.doc_a]
        self.figures.append(np.stack([al.n_a, al.n_b, np.diff(al.doc_group), np.bincount(doc, minlength=docs), np.diff(shared)]))
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else np.zeros(0, np.int64)
        self.doc.append(doc[new] + self.n)
        self.pair.append(pair[new])
        self.times.append(np.diff(np.append(new, len(pair))))
        self.shas += [hashlib.sha256(t).hexdigest() if t else "" for t in al.group_texts()]
        self.ids += ids
        self.n += docs
        self.size += al.bytes + docs

    def row(self, number: int) -> pa.RecordBatch:
        doc, pair, times = (np.concatenate(x) for x in (self.doc, self.pair, self.times))
        pairs, place = np.unique(pair, return_inverse=True)
        many = np.bincount(place, times, minlength=len(pairs)).astype(np.int64)
        figures = np.concatenate(self.figures, 1)
        long_lists = [self.ids, *figures.tolist(), pairs.tolist(), many.tolist()]
        columns = [pa.array([number], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in long_lists]]
        columns += [pa.array([self.shas], pa.list_(pa.string()))]
        columns += [pa.array([x], pa.binary()) for x in (_pack(np.bincount(doc, minlength=self.n), "<u4"), _pack(place, "<u4"), _pack(times, "<u4"))]
        return pa.RecordBatch.from_arrays(columns, _BLOCK_NAMES)


_BLOCK_NAMES = ["block", "doc_id", *_LONGS, "pair", "many", "groups_sha256", "per_doc", "place", "times"]
_BLOCK_SCHEMA = "block long, " + ", ".join(f"{c} array<long>" for c in _BLOCK_NAMES[1:9]) + ", groups_sha256 array<string>, per_doc binary, place binary, times binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, n_best long, count_sum long, groups_sha256 string"


def token_links(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs`` (only doc_id and text are read): how the tokens of two tokenizers meet in its text.

    A is the byte-level tokenizer at ``byte_path`` on space and text, B the piece tokenizer at ``piece_path`` on the text, which adds that
    space itself; special tokens' strings are plain text. Returns doc_id, n_a, n_b, n_groups, n_links (pairs of
    tokens with a common byte), n_shared (pairs in one group), n_best (links whose id pair has the most links of all pairs with that B id,
    ties included), count_sum (over the links, how many links of all texts have their id pair), groups_sha256.
    A text that is null, empty or not reproduced by both tokenizers byte by byte has no tokens: zeros and ''. Repeated rows
    count and are returned as often as they stand; an empty table gives no rows; doc_id may be null. A text is one unit of work: a task
    needs memory for the longest one, some 100 bytes per byte of it.

    Texts are encoded once. A block keeps, compressed, each text's distinct id pairs as places in the block's list of pairs; only
    those lists meet the counts of the whole corpus, by a join on the pair, and return to their block.
    """

    def link(batches):
        number = TaskContext.get().partitionId() << 32
        tools, block = None, _Block()
        for batch in batches:
            for part in blocks(batch):
                tools = tools or Aligner(byte_path, piece_path)
                _, al = tools.align([t or "" for t in part.column("text").to_pylist()])
                block.add(part.column("doc_id").to_pylist(), al, len(tools.b.pieces.size))
                if block.size >= BLOCK_BYTES:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.n:
            yield block.row(number)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    held = materialize(texts.mapInArrow(link, _BLOCK_SCHEMA))
    from sentencepiece import SentencePieceProcessor

    vocabulary_b = SentencePieceProcessor(model_file=piece_path).get_piece_size()
    listed = held.select("block", F.inline(F.arrays_zip("pair", "many")))
    counts = materialize(listed.groupBy("pair").agg(F.sum("many").alias("count")).withColumn("b", F.col("pair") % vocabulary_b))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = listed.select(F.col("block").alias("of"), "pair").join(known, "pair")

    def figure(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in _OUT.split(", ")]
        if left.num_rows:
            # the block's pairs are in ascending order, as the places in it count them
            order = np.argsort(right.column("pair").to_numpy())
            count = right.column("count").to_numpy()[order]
            best = right.column("best").to_numpy()[order]
            row = {c: left.column(c)[0].as_py() for c in left.column_names if c not in ("block", "pair", "many")}
            place, times = _open(row["place"], "<u4"), _open(row["times"], "<u4").astype(np.int64)
            at = _places(_open(row["per_doc"], "<u4").astype(np.int64))
            n_best = np.diff(_places(times * best[place])[at])
            total = np.diff(_places(times * count[place])[at])
            out = [row["doc_id"], *[row[c] for c in _LONGS], n_best, total, row["groups_sha256"]]
        kinds = [pa.int64()] * 8 + [pa.string()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], [f.split()[0] for f in _OUT.split(", ")])

    return held.drop("pair", "many").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(figure, _OUT)
