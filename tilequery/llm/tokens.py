"""Token ids of whole texts under given vocabulary files, and the bytes that each id stands for."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

#: the byte-level splitting rule that the vocabulary was made with: contractions, letters, numbers, other signs, white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a longer run of white space goes to the tokenizer's own, slower splitting
LONGEST_GAP = 100_000
_GAP = re.compile(rf"\s{{{LONGEST_GAP}}}")


def _byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def flatten(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and how many each text has."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(counts.sum())), counts


class Pieces:
    """Bytes of every id, one after the other."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        """The joined bytes of ``ids``."""
        size = self.size[ids]
        total = int(size.sum())
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.at[ids] - first, size) + np.arange(total)]


class ByteBpe:
    """A byte-level BPE of the ``tokenizers`` library, run by ``tiktoken`` on the same vocabulary.

    Both give the same ids. Texts with white space beyond ``LONGEST_GAP`` go to the library itself, and unless ``plain`` so do those
    that hold a special token's string, which then is that token; with ``plain`` such strings are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = [] if plain else list(special)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        sign = _byte_signs()
        ranks = {bytes(sign[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [b""] * (1 + max(*vocabulary.values(), *special.values(), 0))
        for piece, i in ranks.items():
            pieces[i] = piece
        for piece, i in special.items():
            pieces[i] = piece.encode()
        self.pieces = Pieces(pieces)

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or (len(text) >= LONGEST_GAP and _GAP.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(t) for t in texts]


class PieceBpe:
    """A ``sentencepiece`` model; it puts a space before a text and writes unknown signs as bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.pieces = Pieces([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []
