"""Personal data in texts: labelers vote on spans, their reliabilities are estimated, a span classifier learns from them. DataFrame functions only."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilequery.session import materialize

KINDS = ("email", "ip", "card", "phone")

# Every pattern is linear in the text: a run of signs is entered at its beginning only and never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: spans that count as they stand, if :func:`_valid`
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",  # runs of fewer digits never pass
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPEN, _SHUT = r"[\[({<]\x20?+", r"\x20?+[\])}>]"
_GAP = r"[\x20./_ -]{1,2}"
#: other ways of writing them, which the votes decide on
WIDE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?+{_OPEN}(?:at|AT|@){_SHUT}\x20?+{_HOST}++(?:\.{_HOST}++|\x20?+{_OPEN}(?:dot|DOT|\.){_SHUT}\x20?+{_HOST}++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:\.|{_OPEN}(?:\.|dot){_SHUT})[0-9]{{1,3}}+){{3}}+(?![0-9])",
    "card": rf"(?<![0-9])(?:[0-9]{{13,19}}+|[0-9]{{4}}+(?:{_GAP}[0-9]{{4}}+){{2}}+{_GAP}[0-9]{{1,7}}+)(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[\x20-]?+[0-9]{3,4}+[\x20.-]?+[0-9]{3,4}+|00[1-9][0-9]{0,2}+(?:[\x20.()-]{1,2}+[0-9]{1,5}+){2,5}+"
    r"|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9A-Za-z-])",
}
#: what a text must hold to be searched at all
_HINT = {
    "email": ("@", "@"), "ip": (r"[0-9]\.[0-9]++\.[0-9]", ""), "card": (BASE["card"], ""), "phone": (r"\+[0-9]", ""),
}
_WIDE_HINT = {
    "email": rf"{_OPEN}(?:at|AT|@){_SHUT}", "ip": rf"[0-9]{_OPEN}(?:\.|dot){_SHUT}[0-9]",
    "card": r"[0-9]{13}|[0-9]{4}[./_ \x20-]{1,2}[0-9]{4}[./_ \x20-]{1,2}[0-9]{4}", "phone": r"[0-9][).\x20-]\x20?[0-9]{3,4}",
}

# Gazetteers and cue words of the labelers.
TOP_DOMAINS = "com org net edu gov mil int info biz name io co me app dev de fr es it nl be ch at pl se no dk fi pt ie uk us ca au nz jp cn kr in br mx ar ru ua tr za eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: beginnings of numbers of card issuers
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5)|35)"
CUES = {
    "email": "e-?mail|mail|contact|write|reach|kontakt|correo|courriel|to|from", "ip": "ip|host|server|address|addr|client|login|from|dirección|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|iban|tarjeta|carte|karte", "phone": "phone|tel|call|mobile|cell|fax|contact|whatsapp|sms|telefon|teléfono|téléphone",
}
COUNTER_CUES = "version|ver|v|release|isbn|issn|order|sku|part|section|chapter|page|price|total|id|serial|invoice|ticket|build|rev|doi|vol"

#: signs kept on either side of a span
CONTEXT = 40
#: from this probability on a span that is no base span is taken
THRESHOLD = 0.5
_VOTES = ("pattern", "shape", "gazetteer", "cue", "edges", "company")
_SIGNS = 5  # classes of a neighbouring sign
_LENGTHS = (9, 13, 17, 24)  # bounds of the length classes
_BLOCK = 256


def _kept(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed once: without this, expressions are merged into those that use them, per element of an array."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _with_starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """``s_``: where each match of ``f_`` begins, from the lengths of what stands between (``p_``) and of the matches; in blocks, so that many stay cheap."""
    some = lambda n: F.size(f"f_{n}") > 0
    steps = {f"t_{n}": F.when(some(n), F.transform(f"f_{n}", lambda m, i: F.length(F.get(f"p_{n}", i)) + F.length(m))) for n in names}
    rows = _kept(rows.withColumns(steps))
    numbers = lambda n: F.sequence(F.lit(0), F.floor((F.size(f"t_{n}") - 1) / _BLOCK).cast("int"))
    rows = _kept(rows.withColumns({f"b_{n}": F.when(some(n), F.transform(numbers(n), lambda b: _sum(F.slice(f"t_{n}", b * _BLOCK + 1, F.lit(_BLOCK))))) for n in names}))

    def start(n):
        def at(m, i):
            b = F.floor(i / _BLOCK).cast("int")
            return _sum(F.slice(f"b_{n}", F.lit(1), b)) + _sum(F.slice(f"t_{n}", b * _BLOCK + 1, i - b * _BLOCK)) + F.length(F.get(f"p_{n}", i))

        return F.when(some(n), F.transform(f"f_{n}", at))

    out = rows.withColumns({f"s_{n}": start(n) for n in names})
    return _kept(out.drop(*[f"{c}_{n}" for c in "tb" for n in names]))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, v: a + v)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, less 9 beyond 9."""

    def value(i):
        v = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    return _sum(F.transform(F.sequence(F.lit(1), F.length(digits)), value)) % 10 == 0


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _valid(kind: str, m: Column) -> Column:
    """What a match must be besides matching."""
    if kind == "ip":  # parts of at most 255
        plain = F.regexp_replace(m, r"[\[({<]\x20?(?:\.|dot)\x20?[\])}>]", ".")
        return plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 for, -1 against, 0 abstained."""
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0)).cast("int")


def _votes(kind: str, base: bool, m: Column, left: Column, right: Column) -> list[Column]:
    """The labelers' votes on a span, in the order of ``_VOTES``."""
    digits = _digits(m)
    if kind == "email":
        last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        shape, listed = _vote(last.rlike("^[a-z]{2,24}$"), ~last.rlike("^[a-z]{2,24}$")), _vote(last.isin(TOP_DOMAINS), last.rlike("[0-9-]"))
    elif kind == "ip":
        odd = m.rlike(r"(?:^|[^0-9])0[0-9]")
        first = F.regexp_extract(m, "^0*([0-9]{1,3})", 1).cast("int")
        shape, listed = _vote(~odd, odd), _vote(first.between(1, 223) & ~first.isin(10, 127), first.isin(0, 127) | (first > 239))
    elif kind == "card":
        common = F.length(digits).isin(15, 16)
        shape, listed = _vote(common, ~common), _vote(digits.rlike(ISSUERS), digits.rlike("^(?:0|1|9)"))
    else:
        usual = F.length(digits).between(10, 13)
        codes = "|".join(sorted(CALLING_CODES, key=lambda c: (-len(c), c)))
        shape, listed = _vote(usual, ~usual), _vote(m.rlike(rf"^(?:\+|00)(?:{codes})"), digits.rlike(r"^(.)\1{7}"))
    near = F.lower(left)
    cue = _vote(near.rlike(rf"(?<![\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]{{0,4}}$"), near.rlike(rf"(?<![\p{{L}}])(?:{COUNTER_CUES})[^\p{{L}}]{{0,3}}$"))
    glued = left.rlike(r"[\p{L}\p{N}_@./#-]$") | right.rlike(r"^(?:[\p{L}\p{N}_@/#]|[.-][\p{L}\p{N}])")
    edges = _vote(~glued, glued)
    crowded = left.rlike(r"[0-9][^\p{L}]{0,3}$") | right.rlike(r"^[^\p{L}]{0,3}[0-9]")
    return [_vote(F.lit(base)), shape, listed, cue, edges, _vote(~crowded, crowded)]


def _sign(s: Column) -> Column:
    """Class of a neighbouring sign: none, letter, number, space, other."""
    return F.when(s == "", 0).when(s.rlike(r"\p{L}"), 1).when(s.rlike(r"\p{N}"), 2).when(s.rlike(r"\s"), 3).otherwise(4).cast("int")


def _features(m: Column, left: Column, right: Column) -> list[Column]:
    """What the classifier sees of a span besides its kind and votes: length class, neighbouring signs, separators."""
    n = F.length(m)
    size = sum((n > b).cast("int") for b in _LENGTHS)
    parted = F.when(m.rlike(r"[\[({<]"), 2).when(m.rlike(r"[\x20/_ -]"), 1).otherwise(0).cast("int")
    return [size, _sign(F.right(left, F.lit(1))), _sign(F.left(right, F.lit(1))), parted]


_LEVELS = (len(_LENGTHS) + 1, _SIGNS, _SIGNS, 3)
_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row: base spans and other candidates with votes and features, in order of kind and place."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nets = [(f"{name}_{kind}", kind, name == "base", nets[kind]) for name, nets in (("base", BASE), ("wide", WIDE)) for kind in KINDS]
    columns: dict[str, Column] = {}
    for name, kind, base, pattern in nets:
        hint = F.col("text").contains("@") if base and kind == "email" else F.col("text").rlike(_HINT[kind][0] if base else _WIDE_HINT[kind])
        columns[f"f_{name}"] = F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    rows = rows.withColumns(columns)
    # texts go no further than their pieces between matches
    some = lambda name: F.size(f"f_{name}") > 0  # noqa: E731  (null has size -1)
    rows = rows.select("doc_id", *columns, *[F.when(some(n), F.split("text", p, -1)).alias(f"p_{n}") for n, _, _, p in nets])
    rows = _with_starts(rows, [n for n, _, _, _ in nets])

    def made(name, kind, base):
        found, pieces, starts = F.col(f"f_{name}"), F.col(f"p_{name}"), F.col(f"s_{name}")

        def span(m, i):
            left, right = F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))
            start = F.get(starts, i)
            return F.when(
                _valid(kind, m),
                F.struct(
                    F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), F.lit(base).alias("base"),
                    F.array(*_votes(kind, base, m, left, right)).alias("votes"), F.array(*_features(m, left, right)).alias("features"),
                ),
            )

        spans = F.filter(F.transform(found, span), lambda s: s.isNotNull())
        return F.coalesce(F.when(some(name), spans), F.array().cast(_SPAN)).alias(name)

    rows = rows.select("doc_id", *[made(n, k, b) for n, k, b, _ in nets])
    rows = rows.select("doc_id", F.concat(*[f"base_{k}" for k in KINDS]).alias("base"), *[f"wide_{k}" for k in KINDS])
    # a candidate gives way to base spans of any kind, and to candidates of the kinds before its own
    taken = F.col("base")
    for kind in KINDS:
        free = F.filter(F.col(f"wide_{kind}"), lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        rows = rows.select("doc_id", F.when(F.size(f"wide_{kind}") > 0, F.concat(taken, free)).otherwise(taken).alias("base"), *[f"wide_{k}" for k in KINDS[KINDS.index(kind) + 1 :]])
        taken = F.col("base")
    return rows.select("doc_id", F.when(F.size("base") > 1, F.array_sort("base")).otherwise(F.col("base")).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[list[list[float]]]]:
    """Share of true spans and each labeler's chances to vote -1, 0, 1 on a false and on a true span, by expectation-maximisation.

    ``patterns``: votes and how many spans have them. Labelers are taken to err independently. Each begins as one that
    is right in seven of ten votes and keeps that belief as a weight of ten votes on either side.
    """
    k = len(patterns[0][0])
    belief = [[0.6, 0.2, 0.2], [0.2, 0.2, 0.6]]
    share, chance = 0.5, [[list(b) for b in belief] for _ in range(k)]
    for _ in range(rounds):
        true = [posterior(share, chance, votes) for votes, _ in patterns]
        total = sum(n for _, n in patterns)
        weight = sum(p * n for p, (_, n) in zip(true, patterns))
        new = (weight + 5) / (total + 10)
        for lab in range(k):
            for side in (0, 1):
                counts = [10 * b for b in belief[side]]
                for p, (votes, n) in zip(true, patterns):
                    counts[votes[lab] + 1] += n * (p if side else 1 - p)
                chance[lab][side] = [c / sum(counts) for c in counts]
        if abs(new - share) < 1e-12:
            break
        share = new
    return share, chance


def posterior(share: float, chance: list[list[list[float]]], votes: tuple[int, ...]) -> float:
    """Probability that a span with these votes is true."""
    odds = math.log(share / (1 - share)) + sum(math.log(c[1][v + 1] / c[0][v + 1]) for c, v in zip(chance, votes))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _levels() -> list[tuple[int, int]]:
    """Where the indicators of each vote and feature begin, and how many levels it has."""
    sizes = [3] * len(_VOTES) + list(_LEVELS)
    return list(zip([0, *itertools.accumulate(sizes)], sizes))


WIDTH = sum([3] * len(_VOTES) + list(_LEVELS))


def train(rows: list[tuple[list[int], float, float]], width: int, rounds: int = 40, penalty: float = 1.0) -> list[float]:
    """Logistic regression on indicators: rows of (indices, weight, target share); Newton steps with a ridge, by conjugate gradients."""
    w = [0.0] * width
    for _ in range(rounds):
        gradient, scale = [penalty * x for x in w], []
        for indices, n, target in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[i] for i in indices)))))
            for i in indices:
                gradient[i] += n * (p - target)
            scale.append(n * p * (1 - p))

        def curved(x, scale=scale):
            out = [penalty * v for v in x]
            for (indices, _, _), s in zip(rows, scale):
                t = s * sum(x[i] for i in indices)
                for i in indices:
                    out[i] += t
            return out

        step, rest = [0.0] * width, [-g for g in gradient]
        way, size = list(rest), sum(r * r for r in rest)
        for _ in range(2 * width):
            if size < 1e-16:
                break
            bent = curved(way)
            by = size / sum(a * b for a, b in zip(way, bent))
            step = [a + by * b for a, b in zip(step, way)]
            rest = [a - by * b for a, b in zip(rest, bent)]
            size, before = sum(r * r for r in rest), size
            way = [r + size / before * v for r, v in zip(rest, way)]
        longest = max(map(abs, step), default=0.0)
        w = [a + b * min(1.0, 5 / longest) if longest else a for a, b in zip(w, step)]
        if longest < 1e-9:
            break
    return w


class SpanModel:
    """What was learned: per kind the labelers' reliabilities and the classifier's weights (an intercept, then indicators)."""

    def __init__(self):
        self.shares: dict[int, float] = {}
        self.chances: dict[int, list] = {}
        self.weights = [[0.0] * (WIDTH + 1) for _ in KINDS]

    def probability(self, span: Column) -> Column:
        """That a span is personal data, by its kind's weights."""
        w = F.get(F.array(*[F.array(*map(F.lit, w)) for w in self.weights]), span["kind"])
        score = F.get(w, F.lit(0))
        for j, (at, _) in enumerate(_levels()[: len(_VOTES)]):
            score = score + F.get(w, F.get(span["votes"], F.lit(j)) + 1 + at + 1)
        for j, (at, _) in enumerate(_levels()[len(_VOTES) :]):
            score = score + F.get(w, F.get(span["features"], F.lit(j)) + at + 1)
        return 1 / (1 + F.exp(-score))


def fit(found: DataFrame) -> SpanModel:
    """Learn from all candidates of all texts, without labels.

    What reaches the driver is how often each combination of kind, votes and features occurs, whose number is bounded by their levels.
    """
    one = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
    model = SpanModel()
    rows = one.collect()
    for kind in range(len(KINDS)):
        mine = sorted((tuple(r.votes), tuple(r.features), r.n) for r in rows if r.kind == kind)
        if not mine:
            continue
        votes: dict[tuple, int] = {}
        for v, _, n in mine:
            votes[v] = votes.get(v, 0) + n
        share, chance = reliabilities(sorted(votes.items()))
        model.shares[kind], model.chances[kind] = share, chance
        model.weights[kind] = train([(indicators(v, f), n, posterior(share, chance, v)) for v, f, n in mine], WIDTH + 1)
    return model


def indicators(votes: tuple[int, ...], features: tuple[int, ...]) -> list[int]:
    levels = _levels()
    return [0] + [at + v + 2 for (at, _), v in zip(levels, votes)] + [at + f + 1 for (at, _), f in zip(levels[len(votes) :], features)]


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (only doc_id and text are read): the personal data of its whole text.

    Base spans are e-mail addresses, IP addresses, card numbers with a right check digit and telephone numbers with a plus sign as the
    patterns of ``BASE`` find them. Other ways of writing them (``WIDE``: "at" and "dot" in brackets, card numbers among
    other digits or with other separators, numbers without a plus sign) are candidates. Six labelers vote on every span: pattern, shape,
    gazetteer, cue words before it, its edges, digits next to it. Expectation-maximisation over all spans estimates how reliable each
    labeler is; a logistic regression per kind on votes, length, neighbouring signs and separators learns from the resulting
    probabilities and takes the candidates from ``threshold`` on.

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of kind:start:end of the base spans, by kind, then start,
    comma-joined) and spans (all of them, written alike); places are code points, ends exclusive. Null and empty texts have no spans; repeated
    rows are returned as often as they stand and vote as often; an empty table gives no rows; doc_id may be null.
    """
    found = materialize(candidates(docs))
    model = fit(found)
    out = found.select("doc_id", F.filter("spans", lambda s: s["base"]).alias("base"), F.filter("spans", lambda s: s["base"] | (model.probability(s) >= threshold)).alias("all"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))
