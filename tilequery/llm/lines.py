"""Line dedup by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.llm.components import components
from tilequery.session import materialize

#: distinct lines whose ids may be broadcast to pick their texts from the scan; more are joined by shuffle
INLINE_IDS = 1_000_000
#: letters counted for the bag bound that a candidate pair must meet
BAG = "entaiohrsldumc"


def lines_of(docs: DataFrame) -> DataFrame:
    """``row, doc_id, line_no, line, id`` of every line (split at LF) of every text; null texts have none. ``row`` tells rows apart."""
    split = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.withColumn("id", F.xxhash64("line"))


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _segment(n: Column, parts: int, i: Column) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line of ``n`` characters; the last ones take the remainder."""
    short = F.floor(n / parts).cast("int")
    first_long = F.lit(parts) - n % parts
    return short * i + F.greatest(i - first_long, F.lit(0)) + 1, short + (i >= first_long).cast("int")


def probes(edits: int) -> list[tuple[int, int, int, bool]]:
    """Substrings of a line that can equal a segment of a line as long or shorter: (length difference, segment, shift, own segment).

    An alignment with at most ``edits`` edits leaves a segment i untouched with at most i edits before and
    ``edits - i`` after it, which bounds its shift.
    """
    out = []
    for diff in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, diff - (edits - i)), min(i, diff + (edits - i))
            out += [(diff, i, shift, diff == 0 and shift == 0) for shift in range(low, high + 1)]
    return out


def segment_keys(keyed: DataFrame, places: list[tuple[int, int, int, bool]], edits: int) -> DataFrame:
    """``id, bag, own, key`` for each place of each line: length, number and content of the segment looked for."""
    one = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(o).alias("own")) for d, i, s, o in places])
    rows = keyed.select("id", "bag", "line", "n", F.explode(one).alias("p"))
    n = F.col("n") - F.col("p.d")
    start, size = _segment(n, edits + 1, F.col("p.i"))
    rows = rows.withColumns({"m": n, "start": start + F.col("p.s"), "size": size})
    rows = rows.filter((F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    return rows.select("id", "bag", F.col("p.own").alias("own"), F.xxhash64("m", F.col("p.i"), F.substr("line", F.col("start"), F.col("size"))).alias("key"))


_OWN = 1 << (4 * len(BAG))


def _bag() -> Column:
    """How often ``line`` has each letter of ``BAG``, modulo 16, in one number."""
    counts = [F.shiftleft(((F.length("line") - F.length(F.replace("line", F.lit(c)))) % 16).cast("long"), 4 * k) for k, c in enumerate(BAG)]
    return sum(counts[1:], counts[0])


def _bag_distance(a: Column, b: Column) -> Column:
    parts = []
    for k in range(len(BAG)):
        x = F.abs(F.shiftright(a, 4 * k).bitwiseAND(15) - F.shiftright(b, 4 * k).bitwiseAND(15))
        parts.append(F.least(x, 16 - x))
    return sum(parts[1:], parts[0])


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning of two strings, at most ``most`` and 65,535, by halving steps."""
    steps = F.array(*[F.lit(1 << s) for s in range(15, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= most) & (F.substr(a, F.lit(1), p + s) == F.substr(b, F.lit(1), p + s)), p + s).otherwise(p))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings where it is at most ``edits``, else something larger.

    What the strings share at both ends does not change the distance and is cut off first; both get the
    same ``edits`` extra characters, so that the band fits.
    """

    def cut(c, ends):
        middle = F.substr(c, ends["p"] + 1, F.length(c) - ends["p"] - ends["q"])
        # one character each, the empty string has none
        return F.concat(F.filter(F.split(middle, ""), lambda ch: ch != ""), F.array_repeat(F.lit("\n"), edits))

    def measure(ends):
        x, y = cut(a, ends), cut(b, ends)
        return _bound(F.struct(x.alias("x"), y.alias("y")), lambda s: _bound(
            F.struct(F.when(F.size(s["x"]) >= F.size(s["y"]), s["x"]).otherwise(s["y"]).alias("x"), F.when(F.size(s["x"]) >= F.size(s["y"]), s["y"]).otherwise(s["x"]).alias("y")),
            lambda t: F.when(F.size(t["x"]) - F.size(t["y"]) > edits, F.lit(edits + 1)).otherwise(banded_distance(t["x"], t["y"], edits)),
        ))

    most = F.least(F.length(a), F.length(b))
    return _bound(_common(a, b, most), lambda p: _bound(
        F.struct(p.alias("p"), _common(F.reverse(a), F.reverse(b), most - p).alias("q")), measure
    ))


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two character arrays, ``x`` no shorter than ``y``, where it is at most ``edits`` (else something larger).

    Bit-parallel: one column of the diagonal band of ``2 * edits + 1`` rows is two bit vectors (where the value grows and where
    it falls downwards), advanced per character of ``y`` by word operations; the value is followed along
    the band's lower edge, then along the last row. ``x`` must have at least ``edits`` characters.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    full, top, side = F.lit(mask).cast("long"), 1 << (width - 1), 1 << (width - 2)
    bits = [F.lit(1 << b).cast("long") for b in range(width)]
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.lit((mask << edits) & mask).cast("long").alias("vp"), zero.alias("vn"), F.lit(edits).alias("d"), F.lit(side).cast("long").alias("h")
    )

    def flip(v):
        return v.bitwiseXOR(full)

    def column(j):
        ch = F.get(y, j)
        eq = zero
        for b in range(width):
            at = j - edits + b
            eq = eq.bitwiseOR(F.when((at >= 0) & (F.get(x, F.greatest(at, F.lit(0))) == ch), bits[b]).otherwise(zero))
        return F.struct(eq.alias("eq"), (j < F.size(x) - edits).alias("down"))

    def advance(s, e):
        vp, vn, eq = s["vp"], s["vn"], e["eq"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseAND(full)).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn)
        hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        half = F.shiftrightunsigned(d0, 1)
        slid = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
        flat = F.when(hp.bitwiseAND(s["h"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(s["h"]) != 0, 1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(flip(half.bitwiseOR(hp))).alias("vp"),
            half.bitwiseAND(hp).alias("vn"),
            (s["d"] + F.when(e["down"], slid).otherwise(flat)).alias("d"),
            F.when(e["down"], s["h"]).otherwise(F.shiftrightunsigned(s["h"], 1)).alias("h"),
        )

    columns = F.transform(F.sequence(F.lit(0), F.size(y) - 1), column)
    return F.aggregate(columns, start, advance)["d"]


def line_links(distinct: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Candidate pairs (ids ``a < b``) of distinct lines (id, line, n, bag): equal in a segment, in length and in letter counts as far as ``edits`` allow."""
    keyed = distinct.filter(F.col("n") >= min_chars)
    index = segment_keys(keyed, [(0, i, 0, True) for i in range(edits + 1)], edits).select("id", "bag", "key")
    # a line's own segments are among its probes; such a pair is taken from one side only, which a bit above the counts tells
    probe = segment_keys(keyed, probes(edits), edits).select(
        F.col("id").alias("id2"), F.col("bag").bitwiseOR(F.col("own").cast("long") * _OWN).alias("bag2"), "key"
    )
    close = (F.col("id") != F.col("id2")) & ((F.col("bag2") < _OWN) | (F.col("id") < F.col("id2"))) & (_bag_distance(F.col("bag"), F.col("bag2")) <= 2 * edits)
    pairs = index.alias("i").join(probe.alias("r"), (F.col("i.key") == F.col("r.key")) & close)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct (id, line) of the lines whose id is in ``ids``; the ids travel to the scan while they are few."""
    few = ids.limit(INLINE_IDS + 1).count() <= INLINE_IDS
    side = F.broadcast(ids) if few else ids
    return lines.select("id", "line").join(side, "id", "left_semi").distinct()


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 24) -> DataFrame:
    """``row, doc_id, line_no, chars, first_doc_id, first_line_no, copies, kept`` of every line of ``docs`` (doc_id, text).

    Lines of at least ``min_chars`` characters are linked within ``edits`` edits (code points), shorter ones when equal; a
    class is what links reach. ``first_*`` is the class's first line (smallest doc_id, then line number; a null doc_id
    comes first), ``copies`` its lines, ``kept`` marks the first. A line of spaces alone is its own class and
    kept. Null texts have no lines, an empty text has one empty line. Rows equal in doc_id and line
    number are each kept if theirs is the first. Lines are identified by a 64-bit hash; every link is verified on the lines themselves.
    """
    lines = lines_of(docs)
    real = lines.filter(F.trim("line") != "")
    # length and letter counts are measured once, in front of the shuffle that makes lines distinct
    measured = real.select("line", F.length("line").alias("n"), _bag().alias("bag"))
    distinct = measured.groupBy("line", "n", "bag").agg(F.count("*").alias("_n")).select("line", "n", "bag", F.xxhash64("line").alias("id"))
    pairs = materialize(line_links(distinct, edits, min_chars))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = materialize(_texts(real, materialize(ids)))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    links = materialize(both.filter(edit_distance(F.col("la"), F.col("lb"), edits) <= edits).select("a", "b"))
    parts = components(links)

    placed = lines.select("row", "doc_id", "line_no", F.length("line").alias("chars"), "id", (F.trim("line") == "").alias("blank"))
    placed = placed.join(parts, placed["id"] == parts["node"], "left").withColumn("class", F.coalesce("component", "id")).drop("node", "component", "id")
    place = F.struct("doc_id", "line_no")
    heads = placed.filter("not blank").groupBy("class").agg(F.min(place).alias("_first"), F.count("*").alias("_copies"))
    out = placed.join(heads, "class", "left")
    own = F.col("blank")
    first = F.when(own, place).otherwise(F.col("_first"))
    return out.select(
        "row", "doc_id", "line_no", "chars", first["doc_id"].alias("first_doc_id"), first["line_no"].alias("first_line_no"),
        F.when(own, 1).otherwise(F.col("_copies")).cast("long").alias("copies"), (own | (place == F.col("_first"))).alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, edits: int = 2, min_chars: int = 24) -> DataFrame:
    """``docs`` with only the kept lines in ``text``; all other columns stay.

    A document that had a line with text and keeps none goes; null and blank texts stay as they are. Rows are matched by doc_id
    and the text's hash, so rows sharing a doc_id keep their own lines.
    """
    classes = line_classes(docs.select("doc_id", "text"), edits, min_chars)
    gone = classes.filter("not kept").groupBy("row").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("row", "__row")
    joined = docs.withColumn("__key", row_key()).join(gone, F.col("__key") == F.col("__row"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("__text", text).filter(F.col("__gone").isNull() | (F.trim(F.translate("__text", "\n", " ")) != ""))
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
