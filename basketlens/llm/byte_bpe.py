"""Byte-level BPE encoding by a segment tree over byte positions, and decoding.

A text is split by the vocabulary's pattern; each match is merged by itself.
A leaf of the tree stands for the byte position where a live token starts and
holds the rank of that token joined with the next one; an inner node holds
the smallest rank below it, the leftmost of equals, so the root is the next
merge.  A merge changes three leaves (the merged token, its left neighbour,
the token that is gone), each by a walk towards the root that ends where
nothing changes.  A match of n bytes thus takes O(n log n) steps, however
long it is (a line of a million letters is one match).  Short matches that a
worker meets for the first time are merged together, as a forest: one array
holds their trees, and each step makes the next merge in all of them.

As in the tiktoken library, a match that is itself in the vocabulary is one
token, and properties such as ``\\p{L}`` are those of that library's version
of Unicode: where the installed ``regex`` knows more letters, they are taken
out of the pattern.

Ids are packed as little-endian unsigned 32-bit integers.  Matches met before
are kept by the worker (at most ``MOST_KEPT`` short ones, then it starts
anew).  Texts are worked on whole, ``MATCHES_AT_ONCE`` matches at a time.

Nulls: a null text is empty and has no ids; a null doc_id stays.  Repeated
rows are encoded each, ties do not occur (ranks are unique, equal ranks of
one match are taken from the left), an empty table gives no rows, extra
columns and columns whose names differ in case only are left out.  Decoding:
null ids, a length not divisible by four or an id outside the vocabulary give
null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import lean_map, pick, ship
from basketlens.llm.words import slices

MOST_KEPT = 400_000  # and those of MATCHES_AT_ONCE at least
LONGEST_KEPT = 64  # bytes of a match that is kept, and is merged in a forest
TREES_AT_ONCE = 1 << 13
MATCHES_AT_ONCE = 1 << 15
SLICE_BYTES = 1 << 20
_NONE = 1 << 62  # above every rank and position


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of lines ``base64 rank``."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeTree:
    """The live tokens of one match, and the smallest rank of a joined pair of them."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int], longest: int):
        n = len(piece)
        self.piece, self.ranks, self.longest, self.n = piece, ranks, longest, n
        self.after = list(range(1, n + 2))  # where the token that starts here ends
        self.before = list(range(-1, n))  # where the token before this one starts
        self.leaves = 1 << max(n - 1, 1).bit_length()
        tree = [_NONE] * (2 * self.leaves)
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                tree[self.leaves + i] = rank << 32 | i
        for k in range(self.leaves - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left <= right else right
        self.tree = tree

    def _put(self, leaf: int, value: int) -> None:
        tree = self.tree
        k = self.leaves + leaf
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    def _pair(self, start: int) -> int:
        """The entry of the leaf at a live token: its rank when joined with the next one."""
        middle = self.after[start]
        if middle >= self.n:
            return _NONE
        end = self.after[middle]
        if end - start > self.longest:
            return _NONE
        rank = self.ranks.get(self.piece[start:end])
        return _NONE if rank is None else rank << 32 | start

    def merge(self) -> list[int]:
        """Merge until no pair is left; ids of the tokens that remain."""
        tree, after, before, n = self.tree, self.after, self.before, self.n
        while (top := tree[1]) < _NONE:
            start = top & 0xFFFFFFFF
            gone = after[start]
            end = after[start] = after[gone]
            if end < n:
                before[end] = start
            self._put(gone, _NONE)
            self._put(start, self._pair(start))
            if start:
                left = before[start]
                self._put(left, self._pair(left))
        ids, start = [], 0
        while start < n:
            ids.append(self.ranks[self.piece[start : after[start]]])
            start = after[start]
        return ids


class Pairs:
    """Ranks of joined tokens, in sorted arrays: of two bytes by their place, of two tokens by their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary needs a token for each byte")
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        found = ((ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        left, right, rank = np.array(list(found), dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(left << 32 | right)
        self.keys, self.rank = (left << 32 | right)[order], rank[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each two tokens joined; -1 where that is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1) if len(self.keys) else np.full(len(key), -1)


def merge_forest(pieces: list[bytes], pairs: Pairs) -> list[bytes]:
    """Packed ids of each match (up to 256 bytes): the steps of ``MergeTree`` made in all trees together."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    leaves = 1 << max(int(size.max()) - 1, 1).bit_length()
    trees, span = len(pieces), np.arange(leaves)
    data = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8)
    # one entry a place, all trees one after another; place of tree t: t * leaves + byte position
    first = np.arange(trees) * leaves
    stop = first + size
    token = pairs.byte[data]
    after = np.arange(trees * leaves) + 1
    before = after - 2
    place = np.flatnonzero((span[None, :] < size[:, None] - 1).ravel())
    rank = pairs.of(token[place], token[place + 1])
    nodes = np.full((trees, 2 * leaves), _NONE, dtype=np.int64)
    tree = nodes.ravel()
    tree[place + (place // leaves + 1) * leaves] = np.where(rank < 0, _NONE, rank << 8 | place % leaves)
    level = leaves
    while level > 1:
        nodes[:, level // 2 : level] = np.minimum(nodes[:, level : 2 * level : 2], nodes[:, level + 1 : 2 * level : 2])
        level //= 2
    steps = leaves.bit_length() - 1

    def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
        root = row * (2 * leaves)
        k = leaves + leaf
        tree[root + k] = value
        for _ in range(steps):
            k >>= 1
            below = root + 2 * k
            tree[root + k] = np.minimum(tree[below], tree[below + 1])

    def pair(start: np.ndarray, row: np.ndarray) -> np.ndarray:
        middle = after[start]
        inside = middle < stop[row]
        out = np.full(len(row), _NONE)
        s = start[inside]
        rank = pairs.of(token[s], token[middle[inside]])
        out[inside] = np.where(rank < 0, _NONE, rank << 8 | (s - first[row[inside]]))
        return out

    row = np.arange(trees)
    while True:
        top = tree[row * (2 * leaves) + 1]
        row, top = row[top < _NONE], top[top < _NONE]
        if not len(row):
            break
        at = top & 255
        start = first[row] + at
        gone = after[start]
        end = after[start] = after[gone]
        token[start] = top >> 8
        inside = end < stop[row]
        before[end[inside]] = start[inside]
        put(row, gone - first[row], _NONE)
        put(row, at, pair(start, row))
        inner = at > 0
        left, r = before[start[inner]], row[inner]
        put(r, left - first[r], pair(left, r))
    # what is left: the places where a token starts
    place = np.flatnonzero((span[None, :] < size[:, None]).ravel())
    left = before[place]
    place = place[(place % leaves == 0) | (after[np.maximum(left, 0)] == place)]
    packed = token[place].astype("<u4").tobytes()
    cuts = 4 * np.searchsorted(place, np.append(first, trees * leaves))
    return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=4)
def newer_letters(properties: tuple[str, ...]) -> tuple[tuple[int, int], ...]:
    """Ranges of the characters that ``regex`` counts to a property and tiktoken does not."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    bytes_only = {bytes([b]): b for b in range(256)}
    odd: set[int] = set()
    for p in properties:
        encoder = tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=bytes_only, special_tokens={})
        known = encoder.decode_bytes(encoder.encode_ordinary(every)).decode()
        odd |= {ord(c) for c in regex.findall(p, every)} - {ord(c) for c in known}
    points = np.array(sorted(odd), dtype=np.int64)
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return tuple((int(run[0]), int(run[-1])) for run in runs if len(run))


def _properties(pattern: str) -> tuple[str, ...]:
    return tuple(sorted(set(re.findall(r"\\p\{\w+\}", pattern))))


class Encoder:
    """Ids of texts by one vocabulary; ``odd``: ranges of characters on which the pattern's properties must not match."""

    def __init__(self, path: str, pattern: str, odd: tuple[tuple[int, int], ...]):
        self.ranks = read_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.longest = max(map(len, self.ranks))
        self.kept: dict[str, bytes] = {}
        self.pattern = self.exact = regex.compile(pattern, regex.V1)
        self.odd = np.zeros(0x110000, dtype=bool)
        for a, b in odd:
            self.odd[a : b + 1] = True
        if odd:
            ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in odd)
            for p in _properties(pattern):
                pattern = pattern.replace(p, f"[{p}--[{ranges}]]")
            self.exact = regex.compile(pattern, regex.V1)

    def _learn(self, matches: set[str]) -> list[str]:
        """Keep the ids of matches; those that are too long to be kept are returned."""
        short, long = [], []
        for m in matches:
            raw = m.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                self.kept[m] = rank.to_bytes(4, "little")
            elif len(raw) <= LONGEST_KEPT:
                short.append((raw, m))
            else:
                self.kept[m] = np.array(MergeTree(raw, self.ranks, self.longest).merge(), dtype="<u4").tobytes()
                long.append(m)
        short.sort(key=lambda x: len(x[0]))
        for a in range(0, len(short), TREES_AT_ONCE):
            part = short[a : a + TREES_AT_ONCE]
            self.kept.update(zip((m for _, m in part), merge_forest([raw for raw, _ in part], self.pairs), strict=True))
        return long

    def _ids(self, matches: list[str]) -> Iterator[bytes]:
        new = set(matches).difference(self.kept)
        if len(self.kept) + len(new) > MOST_KEPT:
            self.kept.clear()
            new = set(matches)
        long = self._learn(new)
        out = list(map(self.kept.__getitem__, matches))
        for m in long:
            del self.kept[m]
        return iter(out)

    def _matches(self, text: str) -> Iterator[str]:
        pattern = self.pattern
        if pattern is not self.exact and not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            pattern = self.exact
        return iter(pattern.findall(text)) if len(text) <= MATCHES_AT_ONCE else (m.group() for m in pattern.finditer(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, owners = [], []  # matches of some texts; (text, number of its matches held)

        def flush() -> None:
            ids = self._ids(held)
            for i, k in owners:
                out[i].append(b"".join(islice(ids, k)))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            matches = self._matches(text)
            while part := list(islice(matches, MATCHES_AT_ONCE)):
                held += part
                owners.append((i, len(part)))
                if len(held) >= MATCHES_AT_ONCE:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]


class Decoder:
    """Bytes of ids: one array of all tokens' bytes, and where each begins in it."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        self.known = np.zeros(len(tokens), dtype=bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            self.known[rank] = True
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, packed: bytes | None) -> bytes | None:
        if packed is None or len(packed) % 4:
            return None
        ids = np.frombuffer(packed, dtype="<u4")
        if not len(ids):
            return b""
        if ids.max() >= len(self.known) or not self.known[ids].all():
            return None
        parts = []
        for a in range(0, len(ids), 1 << 18):
            some = ids[a : a + (1 << 18)]
            size = self.size[some]
            begin = np.cumsum(size) - size
            parts.append(self.data[np.arange(int(size.sum())) + np.repeat(self.start[some] - begin, size)].tobytes())
        return b"".join(parts)


@cache
def _encoder(path: str, pattern: str, odd: tuple[tuple[int, int], ...]) -> Encoder:
    return Encoder(path, pattern, odd)


@cache
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def _encode(path: str, pattern: str, odd: tuple[tuple[int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, odd)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids = encoder.encode([t or "" for t in part["text"].to_pylist()])
                count = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part["doc_id"], count, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path)
        for batch in batches:
            for part in slices(batch, column, 2 * SLICE_BYTES):
                decoded = pa.array([decoder.decode(x) for x in part.column(column).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    return run


def encode(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document; ``ids`` are packed, see ``ids_array``."""
    ship(documents.sparkSession)
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lean_map(_encode(ranks, pattern, newer_letters(_properties(pattern)))), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """The frame with the binary column ``decoded``: the bytes of its packed ``ids``."""
    ship(encoded.sparkSession)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in encoded.schema.fields)}, decoded binary"
    return encoded.mapInArrow(lean_map(_decode(ranks, encoded.columns.index("ids"))), schema)


def ids_array(packed) -> F.Column:
    """Array of the ids that a packed column holds (an SQL expression)."""
    digits, n = F.hex(packed), F.floor(F.octet_length(packed) / 4).cast("int")
    one = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(digits, 8 * k + 1, 8))
    turned = F.transform(one, lambda x: F.concat(*(F.substring(x, 7 - 2 * b, 2) for b in range(4))))
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.transform(turned, lambda x: F.conv(x, 16, 10).cast("long")))
