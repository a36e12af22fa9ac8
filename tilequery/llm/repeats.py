"""Substring dedup: passages that start earlier elsewhere, found by backward search in FM-indexes of corpus shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequery.llm.text import Words, blocks, mix, span_hashes
from tilequery.session import materialize

#: words of the anchors by which windows are dealt to shards
ANCHOR = 8
#: bytes of text per shard, and of the bit table of repeated anchors (a fixed size at any scale)
SHARD_BYTES, TABLE_BYTES = 3 << 20, 32 << 20
#: bytes of text whose segments are gathered and collapsed before they are sent
SENT_BYTES = 4 << 20
#: windows searched one after the other; longer segments are cut with an overlap
CHAIN = 64
#: different segments of one anchor from which its windows are dealt one by one, by all their words
HOT_SEGMENTS = 1000


def _windows(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of every window that lies in one text, its anchor (the least hash of ``ANCHOR`` consecutive words in it), and all those hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = min(ANCHOR, window)
    g = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)]
    g = every = mix(g)
    span, have = window - width + 1, 1
    while have * 2 <= span:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    if have < span:
        g = np.minimum(g[: len(g) - (span - have)], g[span - have :])
    inside = np.ones(n, bool)
    for cut in np.unique(doc[1:-1]).tolist():  # a window may not cross from one text into the next
        inside[max(0, cut - window + 1) : cut] = False
    at = np.flatnonzero(inside)
    return at, g[at], every


def _segments(at: np.ndarray, anchor: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one text with one anchor: first window, number of windows, anchor."""
    if not len(at):
        return at, at, anchor
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (owner[1:] != owner[:-1])])
    return at[first], np.diff(np.append(first, len(at))), anchor[first]


def _twice(start: np.ndarray, count: np.ndarray, anchor: np.ndarray, every: np.ndarray, window: int) -> np.ndarray:
    """Segments that hold their anchor more than once, so that windows may repeat inside them."""
    size = count + window - min(ANCHOR, window)
    offset = np.concatenate([[0], np.cumsum(size)])
    if not len(start):
        return np.zeros(0, bool)
    at = np.arange(offset[-1]) + np.repeat(start - offset[:-1], size)
    return np.add.reduceat(every[at] == np.repeat(anchor, size), offset[:-1], dtype=np.int64) > 1


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Anchors are the least of many hashes, so small ones are frequent: their bits are spread again before they are dealt."""
    return ((mix(anchor ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bit_of(anchor: np.ndarray, bits: int) -> np.ndarray:
    """Bit of an anchor in its shard's part of the table."""
    return (mix(anchor) % np.uint64(bits)).astype(np.int64)


def _bits_per_shard(shards: int) -> int:
    return min(1 << 24, max(8, TABLE_BYTES * 8 // shards // 8 * 8))  # a shard has far fewer anchors than 2**24


def _kinds(anchor: np.ndarray, digest: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (anchor, digest): the first row of each anchor, the weight of its different digests, and one digest of them all."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])]
    return first, np.add.reduceat(np.where(new, weight, 0), first, dtype=np.uint32), np.bitwise_xor.reduceat(np.where(new, digest, 0).astype(np.uint32), first)


def repeated_anchors(docs: DataFrame, window: int, shards: int, hot: int = HOT_SEGMENTS) -> tuple[list[bytes], np.ndarray]:
    """For each shard, a bit table with the bits of anchors that more than one segment has or one segment twice (and of a few others, by collision).

    Also the sorted anchors of more than ``hot`` different segments: at most one for so many segments of the corpus. Segments are told apart
    by the sets that blocks of texts hold, so a few anchors of fewer segments may be among them, never one of more missing.
    """

    def send(batches):
        for batch in batches:
            for part in blocks(batch, size=SENT_BYTES):
                words = Words(part.column("text"))
                at, anchor, every = _windows(words.hashes(), words.doc, window)
                start, count, anchor = _segments(at, anchor, np.searchsorted(words.doc, at, "right"))
                if not len(start):
                    continue
                twice = _twice(start, count, anchor, every, window)
                digest = (span_hashes(words.hashes(), start, start + count + window - 1) >> np.uint64(32)).astype(np.uint32)
                order = np.lexsort((digest, anchor))
                anchor, digest = anchor[order], digest[order]
                first, kinds, which = _kinds(anchor, digest, np.ones(len(order), np.uint32))
                keys, more = anchor[first], np.add.reduceat(1 + twice[order].astype(np.int64), first) > 1
                which_shard = _shard_of(keys, shards)
                order = np.argsort(which_shard, kind="stable")
                shard, keys, which, kinds, more = which_shard[order], keys[order], which[order], kinds[order], more[order]
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])[: len(shard)]
                parts = [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(shard)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cuts].astype(np.int32)), *[pa.array([v[x].tobytes() for x in parts], pa.binary()) for v in (keys, which, kinds)], pa.array([keys[x][more[x]].tobytes() for x in parts], pa.binary())],
                    ["shard", "once", "which", "kinds", "more"],
                )

    bits = _bits_per_shard(shards)

    def gather(table: pa.Table) -> pa.Table:
        once, which, kinds, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("once", np.uint64), ("which", np.uint32), ("kinds", np.uint32), ("more", np.uint64)))
        order = np.lexsort((which, once))
        first, n, _ = _kinds(once[order], which[order], kinds[order])
        keys = once[order][first]
        found = np.concatenate([keys[np.diff(np.append(first, len(once))) > 1], more])
        flags = np.zeros(bits, bool)
        flags[_bit_of(found, bits)] = True
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([keys[n > hot].tobytes()], pa.binary())], ["shard", "bits", "hot"])

    sent = docs.select("text").mapInArrow(send, "shard int, once binary, which binary, kinds binary, more binary")
    found, busy = {}, []
    for r in sent.groupBy("shard").applyInArrow(gather, "shard int, bits binary, hot binary").toLocalIterator():
        found[r["shard"]] = bytes(r["bits"])
        busy.append(np.frombuffer(bytes(r["hot"]), np.uint64))
    return [found.get(s, b"") for s in range(shards)], np.sort(np.concatenate([np.zeros(0, np.uint64), *busy]))


class BitVector:
    """Bits with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int32))[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class Wavelet:
    """Wavelet matrix: how often a symbol stands in front of a position, one bit vector per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        for bit in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit) & 1 == 1
            vector = BitVector(bits)
            zeros = int(len(symbols) - bits.sum())
            self.levels.append((bit, vector, zeros))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        start = np.zeros(len(symbol), np.int64)
        for bit, vector, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b, c = vector.ones(start), vector.ones(low), vector.ones(high)
            start = np.where(one, zeros + a, start - a)
            low = np.where(one, zeros + b, low - b)
            high = np.where(one, zeros + c, high - c)
        return low - start, high - start


class FMIndex:
    """FM-index of a text of symbols 1.., parts closed by 0, whose suffixes are sorted by ``depth`` symbols, then by place.

    Holds the transform's wavelet matrix, the first row of each symbol, each row's place, and for each row the first and last row
    that agree with it in ``depth - 1`` symbols, by which a match gives up its last symbol.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, have, ranks = text.astype(np.int64), 1, {}
        ranks[1] = rank

        def pair(a, b, step):
            shifted = np.zeros(n, np.int64)
            shifted[: n - step] = b[step:] + 1 if step < n else 0
            return np.unique(a * (n + 2) + shifted, return_inverse=True)[1]

        while have * 2 <= depth - 1:
            rank = pair(rank, rank, have)
            have *= 2
            ranks[have] = rank
        done = have
        for size in sorted(ranks, reverse=True):  # the rest of depth - 1 from smaller powers
            while done + size <= depth - 1:
                rank = pair(rank, ranks[size], done)
                done += size
        shifted = np.zeros(n, np.int64)
        if depth - 1 < n:
            shifted[: n - depth + 1] = text[depth - 1 :]
        self.places = np.argsort(rank * (int(text.max(initial=0)) + 1) + shifted, kind="stable")
        group = rank[self.places]
        cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        number = np.cumsum(np.r_[False, group[1:] != group[:-1]])
        self.first, self.last = cut[number], np.append(cut[1:], n)[number]
        alphabet = int(text.max(initial=0)) + 1
        self.wavelet = Wavelet(text[self.places - 1].astype(np.int64), alphabet)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``symbol`` followed by what the rows [low, high) begin with."""
        a, b = self.wavelet.ranks(symbol, low, high)
        return self.starts[symbol] + a, self.starts[symbol] + b

    def earliest(self, text: np.ndarray, begin: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
        """For chains of ``count`` consecutive windows from ``begin``: the earliest place of each window, last window of a chain first.

        The last window is found by ``depth`` extensions; each one before it gives up the last symbol and is extended once. Returns, aligned
        with (chain, window), places in one array ordered by chain and window.
        """
        offsets = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(offsets[-1], np.int64)
        if not len(begin):
            return out
        end = begin + count - 1  # start of each chain's last window
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(text), np.int64)
        for k in range(depth - 1, -1, -1):
            low, high = self.extend(text[end + k].astype(np.int64), low, high)
        out[offsets[1:] - 1] = self.places[low]
        live = np.arange(len(begin))
        for step in range(1, int(count.max())):
            keep = count[live] > step
            live, low, high = live[keep], low[keep], high[keep]
            low, high = self.first[low], self.last[low]
            low, high = self.extend(text[end[live] - step].astype(np.int64), low, high)
            out[offsets[1:][live] - 1 - step] = self.places[low]
        return out


_RECORD = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("d1", "<u8"), ("d2", "<u8")])


def _covered(start: np.ndarray, repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Merged stretches (start, length) of words covered by repeated windows that begin at ``start + i``."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return []
    cut = np.flatnonzero(np.r_[True, at[1:] - at[:-1] > window])
    ends = at[np.append(cut[1:], len(at)) - 1] + window
    return [(int(start + a), int(e - a)) for a, e in zip(at[cut], ends)]


def _stretches(rec: np.ndarray, pick: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Picked segments of the same text that touch or overlap as one record each, and the number of its first segment."""
    order = pick[np.lexsort((rec["start"][pick], rec["row"][pick]))]
    if not len(order):
        return rec[order], order
    r = rec[order]
    end = r["start"].astype(np.int64) + r["windows"] + window - 1
    other = r["row"][1:] != r["row"][:-1]
    text = np.concatenate([[0], np.cumsum(other)]) << 40
    reach = np.maximum.accumulate(end + text) - text
    first = np.flatnonzero(np.r_[True, other | (r["start"][1:] > reach[:-1])])
    out = r[first]
    out["windows"] = reach[np.append(first[1:], len(r)) - 1] - out["start"] - window + 1
    return out, order[first]


def repeated_spans(docs: DataFrame, window: int = 20, shards: int | None = None, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``row, start, length``: stretches of words covered by windows of ``window`` words that also start earlier.

    ``docs``: row (a long that tells texts apart), doc_id, text. Earlier means: a smaller doc_id (null first), then a smaller row, then an
    earlier start. Stretches of one text may touch or overlap.

    A window belongs to the shard of its anchor, the least hash of eight consecutive words in it, so equal windows meet in one shard.
    Runs of windows with one anchor travel as one segment. A first pass marks the anchors of more than one segment in a bit
    table of fixed size; only their segments travel (when the table fills up, more of them). Equal segments are collapsed
    where they are read and again in the shard; each shard builds an FM-index of its distinct segments in order of place and
    streams them through it.

    An anchor of more than ``hot`` different segments (at the edges of a passage that very many texts share, each with other neighbouring words)
    would fill one shard. Its windows travel one by one to the shard of the hash of all their words: equal ones still meet and collapse, the
    others spread over all shards.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards or max(1, -(-total // SHARD_BYTES))
    return _sent(docs, window, shards, hot).groupBy("shard").applyInArrow(_search(window), "row long, start long, length long")


def _sent(docs: DataFrame, window: int, shards: int, hot: int) -> DataFrame:
    """``shard, words, records``: segments with their words, and without words stretches that are settled where they are read."""
    table = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, window, shards, hot))
    bits = _bits_per_shard(shards)

    def send(batches):
        tables, busy = table.value
        tables = [np.frombuffer(t, np.uint8) for t in tables]
        sizes = np.array([len(t) for t in tables])
        flat = np.concatenate(tables) if tables else np.zeros(0, np.uint8)
        base = np.concatenate([[0], np.cumsum(sizes)])
        seen: dict[int, tuple] = {}
        for batch in batches:
            for part in blocks(batch, size=SENT_BYTES):
                words = Words(part.column("text"))
                h = words.hashes()
                at, anchor, _ = _windows(h, words.doc, window)
                key = anchor
                if len(busy):
                    alone = np.flatnonzero(busy[np.minimum(np.searchsorted(busy, anchor), len(busy) - 1)] == anchor)
                    key = anchor.copy()
                    key[alone] = mix(span_hashes(h, at[alone], at[alone] + window))
                start, count, key = _segments(at, key, np.searchsorted(words.doc, at, "right"))
                anchor = anchor[np.searchsorted(at, start)]
                home = _shard_of(anchor, shards)  # which has the anchor's bit
                bit = _bit_of(anchor, bits)
                byte = base[home] + (bit >> 3)
                on = (sizes[home] > 0) & ((flat[np.minimum(byte, max(0, len(flat) - 1))] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1) if len(flat) else np.zeros(len(bit), bool)
                start, count, shard = start[on], count[on], _shard_of(key[on], shards)
                end = start + count + window - 1
                rec = np.zeros(len(start), _RECORD)
                owner = np.searchsorted(words.doc, start, "right") - 1
                rec["doc"] = part.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)[owner]
                rec["row"] = part.column("row").to_numpy(zero_copy_only=False)[owner]
                rec["start"], rec["windows"] = start - words.doc[owner], count
                rec["d1"] = span_hashes(h, start, end)
                rec["d2"] = span_hashes(h ^ np.uint64(0xD6E8FEB86659FD93), start, end)
                # copies inside the block: the first in order of place goes on, the others are settled here
                order = np.lexsort((rec["start"], rec["row"], rec["doc"], rec["d2"], rec["d1"]))
                same = np.zeros(len(order), bool)
                r = rec[order]
                same[1:] = (r["d1"][1:] == r["d1"][:-1]) & (r["d2"][1:] == r["d2"][:-1])
                # a copy in another block of this task: settled if that one stands earlier
                heads = np.flatnonzero(~same)
                crowd = np.diff(np.append(heads, len(order)))
                for i in heads[crowd > 1].tolist():
                    key, place = int(r["d1"][i]), (int(r["doc"][i]), int(r["row"][i]), int(r["start"][i]))
                    if key in seen and seen[key] < place:
                        same[i] = True
                    elif len(seen) < 200_000:
                        seen[key] = place
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
                later = (r["doc"] != r["doc"][head]) | (r["row"] != r["row"][head]) | (r["start"] != r["start"][head]) | (head == np.arange(len(order)))
                done, settled = _stretches(rec, order[same & later], window)  # an equal row is not earlier
                yield pa.RecordBatch.from_arrays(
                    [pa.array((settled % shards).astype(np.int32)), pa.nulls(len(settled), pa.binary()), pa.array([x.tobytes() for x in done], pa.binary())], ["shard", "words", "records"]
                )
                go = order[~same]
                go = go[np.argsort(shard[go], kind="stable")]
                cuts = np.flatnonzero(np.r_[True, shard[go][1:] != shard[go][:-1]])[: len(go)]
                out: list[list] = [[], [], []]
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(go)).tolist()):
                    mine = go[a:b]
                    size = (end - start)[mine]
                    at_ = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    w = h[at_]  # 40 bits of each word's hash: the lower 4 bytes, then the next one
                    out[0].append(int(shard[mine[0]]))
                    out[1].append(w.astype(np.uint32).tobytes() + (w >> np.uint64(32)).astype(np.uint8).tobytes())
                    out[2].append(rec[mine].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["shard", "words", "records"])

    return docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(send, "shard int, words binary, records binary")


def _search(window: int):
    """Kernel of a shard: its segments collapsed, indexed and searched; ``row, start, length`` of what is repeated."""

    def search(group: pa.Table) -> pa.Table:
        rows, starts, lengths = [], [], []

        def settle(rec, parts):
            for s, n in parts:
                rows.append(int(rec["row"]))
                starts.append(s)
                lengths.append(n)

        records, words = [], []
        for w, r in zip(group.column("words"), group.column("records")):
            rec = np.frombuffer(r.as_py(), _RECORD)
            if not w.is_valid:
                settle(rec[0], [(int(rec[0]["start"]), int(rec[0]["windows"]) + window - 1)])
                continue
            raw = w.as_py()
            n = len(raw) // 5
            words.append(np.frombuffer(raw[: 4 * n], np.uint32).astype(np.int64) | np.frombuffer(raw[4 * n :], np.uint8).astype(np.int64) << 32)
            records.append(rec)
        if records:
            rec = np.concatenate(records)
            content = np.concatenate(words)
            size = rec["windows"] + window - 1
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            order = np.lexsort((rec["start"], rec["row"], rec["doc"]))
            keys = np.stack([rec["d1"], rec["d2"]], 1)
            digest = _dense(keys)
            lead = np.zeros(len(rec), bool)
            leads = order[np.unique(digest[order], return_index=True)[1]]
            lead[leads] = True
            same = np.ones(len(rec), bool)
            for c in ("doc", "row", "start"):
                same &= rec[c] == rec[c][leads][digest]
            for i in np.flatnonzero(~same).tolist():
                settle(rec[i], [(int(rec[i]["start"]), int(size[i]))])
            mine = order[lead[order]]
            begin = np.concatenate([[0], np.cumsum(size[mine] + 1)])
            text = np.zeros(begin[-1], np.int64)
            inner = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(size[mine].sum())
            source = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(size[mine])[:-1]]), size[mine]) + np.arange(size[mine].sum())
            text[inner] = np.unique(content[source], return_inverse=True)[1] + 1
            index = FMIndex(text, window)
            n = rec["windows"][mine].astype(np.int64)
            chains = -(-n // CHAIN)
            which = np.repeat(np.arange(len(mine)), chains)
            k = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(chains)[:-1]]), chains)
            places = index.earliest(text, begin[:-1][which] + k * CHAIN, np.minimum(CHAIN, n[which] - k * CHAIN), window)
            at = np.concatenate([[0], np.cumsum(n)])
            own = np.repeat(begin[:-1] - at[:-1], n) + np.arange(at[-1])
            repeated = places < own
            for i in np.flatnonzero(np.add.reduceat(repeated, at[:-1]) if len(n) else []).tolist():
                settle(rec[mine[i]], _covered(rec[mine[i]]["start"], repeated[at[i] : at[i + 1]], window))
        return pa.table([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], ["row", "start", "length"])

    return search


def _dense(keys: np.ndarray) -> np.ndarray:
    """A number for each distinct row of two columns."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[False, (keys[order][1:] != keys[order][:-1]).any(1)]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def drop_repeats(docs: DataFrame, window: int = 20, shards: int | None = None, hot: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, text, n_words, n_removed``: each text's words that no repeated window covers, joined by one space.

    Words are runs of other signs than space and 0x09-0x0D, taken as they are. A window is ``window`` consecutive words of one text;
    it is repeated if its words also start earlier (smaller doc_id, or the same text further in front), judged on the input. A
    null text has no words and becomes empty; shorter texts keep their words. Rows with one doc_id and text are one text,
    each gets its result; rows that share a doc_id only come in the order of a hash. An empty table gives no rows.
    """
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    spans = materialize(repeated_spans(keyed, window, shards, hot).distinct())
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    joined = keyed.join(lists, "row", "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))

    def cut(batches):
        for batch in batches:
            for part in blocks(batch):
                words = Words(part.column("text"))
                raw = words.raw.tobytes()
                texts, total, removed = [], words.counts().tolist(), []
                for i, (starts, lengths) in enumerate(zip(part.column("starts").to_pylist(), part.column("lengths").to_pylist())):
                    a, b = words.doc[i], words.doc[i + 1]
                    keep = np.ones(b - a, bool)
                    for s, n in zip(starts or (), lengths or ()):
                        keep[s : s + n] = False
                    removed.append(int((~keep).sum()))
                    at = np.flatnonzero(keep) + a
                    texts.append(b" ".join([raw[x:y] for x, y in zip(words.start[at].tolist(), words.end[at].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"]
                )

    return joined.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")
