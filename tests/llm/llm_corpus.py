"""A small corpus with the awkward cases: nulls, empty, long and repeated texts, near copies, shared passages, shouting."""

from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, score double, shard int, n int, label string"


def words(text) -> list[str]:
    return WORD.findall(text or "")


def lower(text) -> str:
    return (text or "").translate(LOW)


def corpus() -> list[tuple]:
    rng = random.Random(3)
    syllables = ["an", "er", "the", "ing", "st", "é", "ou", "ha", "ti", "ñ", "on", "re"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."

    texts = ["\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    passage = line(45)
    for i in range(12):  # exact copies, near copies, a shared passage, a repeated line
        texts.append(texts[i])
        at = texts[i].split(" ")
        at[len(at) // 2] = "changed"
        texts.append(" ".join(at))
        texts.append(line(8) + "\n" + passage + "\n" + line(9))
        texts.append(texts[20 + i] + "\n" + texts[5].split("\n")[0])
    for i in range(6):  # lines a few letters away from each other
        base = list(line(12))
        base[4 + i] = "x"
        texts += ["".join(base), "".join(base[:9] + base[9 + i % 3 :]), "".join(base).replace("e", "é", 1)]
    texts += [None, "", " ", "\n\n", "one", "two words", "a a a a a a a a a a a a a a a a a a a a a a a a a a", "the the " * 30, "É" * 30, " ".join(vocabulary * 12), "12345 6789", "!!! ???"]
    rows = [(i, t, "xx" if i % 3 else "yy", "src", len(t or ""), 1, 2, 0.5, 3, 4, "l") for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((11, texts[3] + " more", None, None, None, None, None, None, None, None, None))  # an id used twice
    rows.append((None, texts[4], None, None, 7, 1, 2, 0.5, 3, 4, "l"))  # no id
    return rows


def edit_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


class Groups:
    """Union of what belongs together; a group's name is its smallest member."""

    def __init__(self):
        self.over: dict = {}

    def find(self, x):
        self.over.setdefault(x, x)
        while self.over[x] != x:
            x = self.over[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.over[max(a, b)] = min(a, b)


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
