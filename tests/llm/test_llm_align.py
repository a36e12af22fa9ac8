"""Token links against products written out by hand."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_corpus import docs, empty, rows  # noqa: F401

from tilequery.llm import align

PATHS = [__import__("public_tokenizers").path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


def token_bytes():
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    signs = {c: i for i, c in {b: c for c, b in align_signs()}.items()}
    assert ByteLevel().decode(["Ġa"]) == " a"

    def of_a(text):
        return [(i, bytes(signs[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return of_a, of_b


def align_signs():
    from tilequery.llm.tokens import _byte_signs

    return _byte_signs().items()


def brute(texts):
    """Figures of each text by comparing every A token with every B token."""
    of_a, of_b = token_bytes()
    made = []
    for text in texts:
        a, b = of_a(text or ""), of_b(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            made.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        group = [[next(k for k, c in enumerate(cuts) if e <= c) for _, _, e in side] for side in spans]
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        text_ = ";".join("|".join(",".join(str(t[0]) for t, g in zip(side, groups) if g == k) for side, groups in zip(spans, group)) for k in range(len(cuts)))
        shared = sum(g == h for g in group[0] for h in group[1])
        made.append((len(a), len(b), len(cuts), shared, links, hashlib.sha256(text_.encode()).hexdigest()))
    count = Counter(p for m in made if m for p in m[4])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    zero = (0, 0, 0, 0, 0, 0, 0, "")
    return [(m[0], m[1], m[2], len(m[4]), m[3], sum(count[p] == most[p[1]] for p in m[4]), sum(count[p] for p in m[4]), m[5]) if m else zero for m in made]


def test_links(spark, docs, empty, monkeypatch):  # noqa: F811
    from pyspark.sql import functions as F

    odd = ["a ▁ b", "<|endoftext|> and </s> <0x0A>", "日本語 \x00 ​ 😀", "  two  spaces\n\n\ttab ", "x" * 300, "ﬁ é \r\n"]
    some = docs.filter(F.length("text") < 400).select("doc_id", "text", "lang").union(spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(odd)], "doc_id long, text string, lang string"))
    some = some.union(docs.filter("text is null").select("doc_id", "text", "lang")).repartition(3)
    monkeypatch.setattr(align, "BLOCK_BYTES", 2000)  # several blocks a task
    have = some.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(have, brute([r.text for r in have])))
    got = align.token_links(some, *PATHS).collect()
    assert Counter((r.doc_id, *[r[f] for f in FIELDS]) for r in got) == want
    assert sum(r.n_a == 0 for r in got) >= 3 and max(r.n_shared for r in got) > max(r.n_links for r in got) - 1
    assert align.token_links(empty, *PATHS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(0, 6), st.integers(0, 5), st.data())
def test_row_products(n, m, k, data):
    x, y = (np.array(data.draw(st.lists(st.booleans(), min_size=a * b, max_size=a * b))).reshape(a, b).astype(int) for a, b in ((n, m), (m, k)))
    left, right = (align.Csr.by_row(*np.nonzero(z), *z.shape) for z in (x, y))
    out = np.zeros((n, k), int)
    r, c, v = left.product(right)
    out[r, c] = v
    assert (out == x @ y).all() and len(r) == np.count_nonzero(x @ y)
    assert (left.row_sizes_of_product(right) == (x @ y).sum(1)).all()
    t = left.transpose()
    assert [sorted(t.cols[t.at[j] : t.at[j + 1]]) for j in range(m)] == [np.flatnonzero(x[:, j]).tolist() for j in range(m)]


def test_long_text():
    tools = align.Aligner(*PATHS)
    good, al = tools.align(["word " * 100_000, "", " " * 150_000])
    assert good.tolist() == [True, False, True] and al.n_a[0] == 100_001 and al.n_groups >= 100_000
