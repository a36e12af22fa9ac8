"""Whole texts as arrays: blocks of an Arrow batch, words and their hashes, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: bytes of text handled at once; a longer text is a block of its own
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: everything but ASCII letters and digits and the bytes of longer characters
NO_WORD = np.ones(256, bool)
NO_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: as before, digits too are no part of a word
NO_LETTER = NO_WORD.copy()
NO_LETTER[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept for the next block."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """64-bit hashes of spans of an array, the same wherever a span stands."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(_P, n)[:n], out=self.sums[1:])
        self.back = _powers(_P_INV, n + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``values[start:end]``."""
    return Spans(values).hashes(starts, ends)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins and ends (nulls are empty)."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK):
    """Parts of a batch with about ``size`` bytes of text each, every row in one part."""
    n = batch.num_rows
    if not n:
        return
    _, at = text_buffers(batch.column(column))
    first = 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """Words (runs of other bytes than ``gaps``: space and 0x09-0x0D) of a block of texts.

    ``start``/``end``: byte positions in ``raw``; ``doc``: words of text i are ``doc[i]:doc[i + 1]``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE):
        self.raw, at = text_buffers(texts)
        self.text_at = at
        n = len(self.raw)
        space = gaps[self.raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        inner = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        before |= edge[:-1]
        after |= edge[1:]
        self.start = np.flatnonzero(inner & before)
        self.end = np.flatnonzero(inner & after) + 1
        self.doc = np.searchsorted(self.start, at)
        self.lower = lower

    def spans(self) -> Spans:
        return Spans(_LOWER[self.raw] if self.lower else self.raw)

    def hashes(self) -> np.ndarray:
        return self.spans().hashes(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in each text and how many each text has.

    A text with fewer words, but at least one, has its whole sequence as the only shingle.
    """
    n = len(words)
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(many, out=out_at[1:])
    # position of each shingle's first word
    first = np.arange(out_at[-1], dtype=np.int64) + np.repeat(at[:-1] - out_at[:-1], many)
    h = np.zeros(out_at[-1], np.uint64)
    left = np.repeat(at[1:], many) - first
    for k in range(width):
        w = words[np.minimum(first + k, n - 1)] if n else words
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + np.where(left > k, w, np.uint64(0)) + np.uint64(k + 1))
    return h, many


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark longs (same bits)."""
    return pa.array(x.view(np.int64), pa.int64())
