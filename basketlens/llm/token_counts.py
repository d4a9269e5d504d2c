"""Token counts of the sections of a text, by offsets of one encoding.

A text is encoded once as a whole.  Each token's bytes give its span of
characters; spans are joined with the spans of the sections.  A token that
crosses a boundary goes, by the rule

* ``majority``: to the section that has most of its characters, the earlier
  one if equal;
* ``start``: to the section of its first character.

So each token is counted once and the counts of a text add up to its tokens.
A character of several tokens counts for the token that begins it; a token
that only continues it goes to the same section.

Sections are the lines of a text, each with the newline that ends it; or the
array column ``sections`` of (start, end) character spans, in order and not
overlapping, of which what is outside is section null.

Nulls: a null text is one empty line; a null doc_id stays.  Repeated rows are
counted each.  An empty table gives no rows.  Ties: of sections with equally
many characters of a token the earlier one gets it.  Extra columns and columns
whose names differ in case only are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import lean_map, pick, ship

RULES = ("majority", "start")
_COUNT = "doc_id long, section int, start_char long, n_chars long, n_tokens long, n_crossing long"

_KEPT: dict[str, tuple] = {}


def _tokenizer(path: str, pattern: str) -> tuple:
    """(encoder, bytes in each token) of a file of ranks; kept by the worker."""
    if path not in _KEPT:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _KEPT[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _KEPT[path]


def token_spans(ids: np.ndarray, size: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first character, end, characters begun before each byte) of tokens over the UTF-8 bytes of a text."""
    begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    end = np.cumsum(size[ids])
    start = end - size[ids]
    first, after = begun[start], begun[end]
    return np.where(first == after, np.maximum(after - 1, 0), first), after, begun


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section, crosses a boundary) of each token; section k is bounds[k] to bounds[k + 1]."""
    last = len(bounds) - 2
    lo = np.clip(np.searchsorted(bounds, start, "right") - 1, 0, last)
    hi = np.clip(np.searchsorted(bounds, np.maximum(end, start + 1), "left") - 1, lo, last)
    section = lo.copy()
    crossing = hi > lo
    if rule == "majority":
        for t in np.flatnonzero(crossing):
            k = np.arange(lo[t], hi[t] + 1)
            part = np.minimum(end[t], bounds[k + 1]) - np.maximum(start[t], bounds[k])
            section[t] = k[np.argmax(part)]
    return section, crossing


def _line_bounds(raw: np.ndarray, begun: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], begun[np.flatnonzero(raw == 10) + 1], [begun[-1]]])


def _span_bounds(spans: list, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that cover the whole text, and the number of the section at each (-1: outside)."""
    bounds, number = [0], []
    for i, s in enumerate(spans or []):
        a, b = max(min(s["start"], chars), bounds[-1]), min(s["end"], chars)
        if a > bounds[-1]:
            number.append(-1)
            bounds.append(a)
        if b >= a:
            number.append(i)
            bounds.append(b)
    if bounds[-1] < chars or not number:
        number.append(-1)
        bounds.append(chars)
    return np.array(bounds), np.array(number)


def _count(path: str, pattern: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = _tokenizer(path, pattern)
        for batch in batches:
            doc, parts = [], []
            sections = batch["sections"].to_pylist() if given else None
            for i, text in enumerate(batch["text"].to_pylist()):
                text = text or ""
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                ids = np.array(encoder.encode_ordinary(text), dtype=np.int64)
                start, end, begun = token_spans(ids, size, raw)
                if given:
                    bounds, number = _span_bounds(sections[i], int(begun[-1]))
                else:
                    bounds = _line_bounds(raw, begun)
                    number = np.arange(len(bounds) - 1)
                section, crossing = attribute(start, end, bounds, rule)
                n = len(number)
                parts.append(np.stack([number, bounds[:-1], np.diff(bounds), np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)]))
                doc.append(np.full(n, i))
            if parts:
                all_parts = np.concatenate(parts, axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].take(pa.array(np.concatenate(doc))), pa.array(all_parts[0].astype(np.int32), mask=all_parts[0] < 0),
                    *(pa.array(x.astype(np.int64)) for x in all_parts[1:]),
                ], names=["doc_id", "section", "start_char", "n_chars", "n_tokens", "n_crossing"])

    return run


def token_counts(documents: DataFrame, ranks: str, pattern: str, rule: str = "majority") -> DataFrame:
    """(doc_id, section, start_char, n_chars, n_tokens, n_crossing) of each section.

    ``ranks``, ``pattern``: vocabulary file and split pattern of a byte-level
    BPE.  ``n_crossing``: tokens counted here that also have characters elsewhere.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ship(documents.sparkSession)
    given = "sections" in documents.columns
    docs = pick(documents, "doc_id", "text", *["sections"] * given).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(lean_map(_count(ranks, pattern, rule, given)), _COUNT)
