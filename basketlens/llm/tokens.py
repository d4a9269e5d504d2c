"""Token ids of words, encoded once each and kept in sorted hash arrays.

Both tokenizers used here never join characters across white space, so the
ids of a text are those of its words in order.  A worker keeps the words it
has met (``MOST_WORDS`` at most, then it starts anew), so a word costs one
encoding and later a binary search.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

from basketlens.llm.words import U, Words

MOST_WORDS = 1 << 20
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class WordTokens:
    """Ids of words: ``pool[start : start + count]`` for each distinct word."""

    def __init__(self, encode: Encode):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at = np.zeros(0, U), np.zeros(0, np.int64)
        self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == keys[inside]
        return spot, known

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(start in ``pool``, number of ids) of each word."""
        codes, keys = pd.factorize(words.hashes())
        if len(keys) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot, known = self._find(keys)
        if not known.all() and len(self.keys) + (~known).sum() > MOST_WORDS:
            self._clear()
            spot, known = self._find(keys)
        if not known.all():
            first = np.empty(len(keys), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            new = new[np.argsort(keys[new])]
            ids, count = self.encode([words.string(i).decode() for i in first[new].tolist()])
            place = np.searchsorted(self.keys, keys[new])
            start = len(self.pool) + np.cumsum(count) - count
            self.keys = np.insert(self.keys, place, keys[new])
            self.at = np.insert(self.at, place, start)
            self.count = np.insert(self.count, place, count)
            self.pool = np.concatenate([self.pool, ids])
            spot, _ = self._find(keys)
        return self.at[spot][codes], self.count[spot][codes]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return np.arange(total) + np.repeat(start - (end - count), count)


def tokenizers_words(path: str) -> Encode:
    """Encoder of a tokenizer file of the ``tokenizers`` library; many words make one call."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            begin = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            got = tokenizer.encode("\n".join(part), add_special_tokens=False)
            at = np.fromiter((x for x, _ in got.offsets), np.int64, len(got.ids))
            ids.append(np.array(got.ids, dtype=np.uint32))
            counts.append(np.bincount(np.searchsorted(begin, at, "right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    return encode


def sentencepiece_words(path: str) -> Encode:
    """Encoder of a ``sentencepiece`` model: each word as a text of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = model.encode(words, num_threads=1)
        count = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(count.sum())), count

    return encode


_KEPT: dict[tuple[str, str], WordTokens] = {}


def word_tokens(kind: str, path: str) -> WordTokens:
    """The worker's own words of a tokenizer file."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = WordTokens({"tokenizers": tokenizers_words, "sentencepiece": sentencepiece_words}[kind](path))
    return _KEPT[kind, path]
