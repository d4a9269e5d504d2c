"""Words of whole texts as 64-bit hashes, computed over Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D, unchanged.  A text
of millions of words costs a few array passes; no string objects are made.
Hashes are polynomials modulo 2**64 over random byte values, mixed at the
end, so equal words have equal hashes and different ones collide with a
chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}
BLOCK_BYTES = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept, and made longer when needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=U)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=U)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ U(salt & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some texts, one after another.

    ``data``: the bytes of all texts, each followed by one space; ``text_end``:
    where each text ends in it (that space included); ``starts``, ``ends``:
    of each word; ``first``: the first word of each text, and one entry more.
    """

    data: np.ndarray
    text_end: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        return self.span_hashes(self.starts, self.ends)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans of bytes, in order; equal spans have equal hashes.

        Works on about ``BLOCK_BYTES`` at a time (one span at least).
        """
        out = np.zeros(len(starts), dtype=U)
        i = 0
        while i < len(starts):
            a = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, a + BLOCK_BYTES)))
            data = self.data[a : ends[j - 1]]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(data) + 1, dtype=U)
                np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, len(data)), out=sums[1:], dtype=U)
                own = (sums[ends[i:j] - a] - sums[starts[i:j] - a]) * _powers(_INVERSE, len(data) + 1)[starts[i:j] - a]
            out[i:j] = mix(own, 0x51)
            i = j
        return out

    def string(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Words of each text (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    spaced = pc.binary_join_element_wise(
        texts.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()),
        null_handling="replace", null_replacement=b"",
    )
    if isinstance(spaced, pa.ChunkedArray):
        spaced = spaced.combine_chunks()
    _, offsets, values = spaced.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[spaced.offset : spaced.offset + len(spaced) + 1] if len(spaced) else np.zeros(1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    text_end = offsets[1:] - offsets[0]
    inside = ~_SPACES[data]
    edges = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.concatenate([[0], np.searchsorted(starts, text_end)])
    return Words(data, text_end, starts, ends, first)


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (across texts too: see ``grams``)."""
    if len(word_hashes) < n:
        return np.zeros(0, dtype=U)
    m = len(word_hashes)
    with np.errstate(over="ignore"):
        sums = np.zeros(m + 1, dtype=U)
        np.cumsum(word_hashes * _powers(_BASE, m), out=sums[1:], dtype=U)
        own = (sums[n:] - sums[:-n]) * _powers(_INVERSE, m - n + 1)
    return mix(own, n)


def grams(words: Words, n: int, short_as_one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text: (hash, start word in its text, first per text).

    With ``short_as_one``, a text of 1 to n-1 words has one run: all its words.
    """
    hashes, counts = words.hashes(), words.counts
    runs = np.maximum(counts - n + 1, 0)
    all_runs = gram_hashes(hashes, n)
    if short_as_one:
        short = (counts > 0) & (counts < n)
        runs[short] = 1
    first = np.concatenate([[0], np.cumsum(runs)])
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(first[-1]) - first[text]
    index = words.first[text] + at
    if not short_as_one or not short.any():
        return all_runs[index] if len(index) else np.zeros(0, U), at, first
    out = np.zeros(len(index), dtype=U)
    long = ~short[text]
    out[long] = all_runs[index[long]]
    for i in np.flatnonzero(short):
        k = int(counts[i])
        out[first[i]] = gram_hashes(hashes[words.first[i] : words.first[i] + k], k)[0]
    return out, at, first


def slices(batch: pa.RecordBatch, column: str | int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many bytes in one column (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most_bytes
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
