"""Token ids of whole texts, and bounded-space best-fit packing of documents into sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.text import blocks
from tilequery.llm.tokens import ByteBpe
from tilequery.session import materialize

#: windows kept open per task
OPEN_WINDOWS = 32
#: left-over windows merged in one task
MERGE_WINDOWS = 8192

class TokenIds:
    """Ids of the texts of an Arrow array (null: none)."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.bpe.encode([t or "" for t in texts.to_pylist()])]


class Windows:
    """A fixed number of open windows; a piece goes where the least room is left, else the fullest window is closed."""

    def __init__(self, length: int, most: int, base: int):
        self.length, self.most, self.next = length, most, base
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list] = {}

    def add(self, size: int, piece) -> list | None:
        """Place a piece; returns the pieces of a window that was closed for it or became full."""
        i = bisect_left(self.room, (size, -1))
        closed = None
        if i < len(self.room):
            room, window = self.room.pop(i)
        else:
            if len(self.room) >= self.most:
                closed = self.held.pop(self.room.pop(0)[1])
            room, window = self.length, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((*piece, window, self.length - room))
        if room == size:
            full = self.held.pop(window)
            return full if closed is None else closed + full
        insort(self.room, (room - size, window))
        return closed

    def rest(self) -> list:
        return [p for held in self.held.values() for p in held]


_FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _rows(pieces: list, open_: bool) -> pa.RecordBatch:
    columns = list(zip(*pieces)) if pieces else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([open_] * len(pieces), pa.bool_())], [*_NAMES, "open"])


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens, one row per piece.

    A document is its text's ids and ``end_id``. It is cut every ``length`` ids; its last piece goes to the open window of its
    task with the least room that fits; where none fits, the fullest is closed and a new one opened. Windows
    still open at a task's end are taken apart and packed anew, longest piece first, with the left-overs of other tasks.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is ``end_id`` alone; rows
    with the same or no doc_id are packed each for itself; an empty table gives no rows.
    Memory per task: the open windows and one block of text.
    """
    schema = f"{_FIELDS}, open boolean"

    def place(batches):
        made = None
        seen = Windows(length, windows, TaskContext.get().partitionId() << 32)
        done: list = []
        for batch in batches:
            for part in blocks(batch, size=1 << 19):
                made = made or TokenIds(tokenizer)
                for doc, ids in zip(part.column("doc_id").to_pylist(), made.encode(part.column("text"))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    for at in range(0, n, length):
                        cut = ids[at : at + length]
                        out = seen.add(len(cut), (doc, at, len(cut), zlib.crc32(cut.tobytes()), n))
                        if out:
                            done += out
                if len(done) > 5000:
                    yield _rows(done, False)
                    done = []
        yield _rows(done, False)
        yield _rows(seen.rest(), True)

    placed = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(place, schema))
    left = placed.filter("open")
    n_windows = left.filter("offset = 0").count()
    tasks = max(1, -(-n_windows // MERGE_WINDOWS))

    def merge(batches):
        seen = Windows(length, MERGE_WINDOWS * 4, (1 << 61) + (TaskContext.get().partitionId() << 32))
        rows = [tuple(r[c] for c in _NAMES[:5]) for b in batches for r in b.to_pylist()]
        done: list = []
        for piece in sorted(rows, key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1], r[3])):
            done += seen.add(piece[2], piece) or []
        yield _rows(done + seen.rest(), False)

    merged = left.repartition(tasks, "sequence_id").mapInArrow(merge, schema)
    return placed.filter("not open").unionByName(merged).drop("open")
