"""Benchmark decontamination: documents that contain a benchmark item.

An item is contained in a document if at least ``threshold`` of its distinct
``n``-word shingles are among the document's.  An item of k < n words has one
shingle, all its words, and is contained where these stand in a row: it is
looked up among the document's runs of k words, for each such k there is.

Items are partitioned by size.  An item of m shingles may miss
floor((1 - threshold) m) of them, so of any floor((1 - threshold) m) + 1 at
least one is in each document that contains it.  Its MinHash signature is
that many of its smallest hash values (the bottom-k sketch of a containment
search; k is set by the size partition from its largest size).  Searched are
the sketch values among all shingles of the document, so nothing is lost
however long the document is; a document too short for a partition skips it.
Candidates are verified by exact containment while the document's shingles
are at hand, so documents are never shuffled.

Items are a query set: they are broadcast in blocks of at most
``BLOCK_SHINGLES`` shingles (16 MB), each block in a pass over the documents,
so a benchmark of any size fits.

Nulls: a null or empty item contains nothing and is in no document; a null
or empty document contains no item; null ids stay.  Repeated items count as one
each time (by item_id); repeated documents are reported each time.  Ties do not
occur: every item a document contains is reported.  Empty tables give no rows.
Extra columns and columns whose names differ in case only are left out
(``without_items`` returns them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import checkpoint, lean_map, pick, ship
from basketlens.llm.tokens import spread
from basketlens.llm.words import U, grams, mix, slices, words_of

SHINGLE = 5
THRESHOLD = 0.8
BLOCK_SHINGLES = 1 << 21
_FILTER_BITS = 22

_PAIR = "doc_id long, item_id long, n_shared int, n_shingles int"


@dataclass
class Items:
    """A block of items: distinct shingles of each, and their sketches by size partition."""

    ids: np.ndarray
    null_id: np.ndarray
    shingles: np.ndarray
    first: np.ndarray
    needed: np.ndarray
    sketch: np.ndarray
    owner: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted shingles of shorter items, and whose

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def sketch_size(size: np.ndarray, threshold: float) -> np.ndarray:
    """Sketch values an item of so many shingles needs: those of the largest of its size partition."""
    largest = 2 ** (np.floor(np.log2(size)).astype(np.int64) + 1) - 1
    return np.minimum(size, np.floor((1 - threshold) * largest + 1e-9).astype(np.int64) + 1)


def make_items(rows: list, threshold: float) -> Items:
    """rows: (item_id, distinct shingle hashes as bytes, words if fewer than a shingle's, else 0)."""
    sets = [np.frombuffer(r[1], U) for r in rows]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    words = np.array([r[2] for r in rows])
    short = {}
    for k in sorted(set(words[words > 0].tolist())):
        own = np.flatnonzero(words == k)
        one = np.concatenate([sets[i] for i in own])
        short[k] = np.sort(one), own[np.argsort(one)]
    sketch, owner = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for i, k in enumerate(sketch_size(size, threshold)):
        if words[i]:
            continue
        low = np.argsort(mix(sets[i], 0x31), kind="stable")[:k]
        sketch.append(sets[i][low])
        owner.append(np.full(len(low), i))
    sketch, owner = np.concatenate(sketch), np.concatenate(owner)
    order = np.argsort(sketch, kind="stable")
    needed = np.ceil(threshold * size - 1e-9).astype(np.int64)
    ids = np.array([0 if r[0] is None else r[0] for r in rows], dtype=np.int64)
    return Items(ids, np.array([r[0] is None for r in rows]), np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), needed, sketch[order], owner[order], short)


def _filter(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _FILTER_BITS, dtype=bool)
    out[values >> U(64 - _FILTER_BITS)] = True
    return out


def find(items: Items, maybe: np.ndarray, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, shared shingles) of each text and each item that it contains."""
    words = words_of(texts)
    hashes, _, first = grams(words, n, short_as_one=False)
    size = items.sizes
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    hit = np.flatnonzero(maybe[hashes >> U(64 - _FILTER_BITS)])
    left, right = (np.searchsorted(items.sketch, hashes[hit], side) for side in ("left", "right"))
    hit, left, count = hit[right > left], left[right > left], (right - left)[right > left]
    pairs = np.unique(np.repeat(text[hit], count) * len(size) + items.owner[spread(left, count)])
    rows, last, own = [], -1, None
    for p in pairs.tolist():
        d, i = divmod(p, len(size))
        if first[d + 1] - first[d] < items.needed[i]:  # too short for the item
            continue
        if d != last:
            last, own = d, np.unique(hashes[first[d] : first[d + 1]])
        shingles = items.shingles[items.first[i] : items.first[i + 1]]
        spot = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        shared = int((own[spot] == shingles).sum())
        if shared >= items.needed[i]:
            rows.append((d, i, shared))
    for k, (shingles, owner) in items.short.items():
        runs, _, first = grams(words, k, short_as_one=False)
        left, right = (np.searchsorted(shingles, runs, side) for side in ("left", "right"))
        hit = np.flatnonzero(right > left)
        text = np.repeat(np.arange(len(texts)), np.diff(first))[hit]
        count = (right - left)[hit]
        pairs = np.unique(np.repeat(text, count) * len(size) + owner[spread(left[hit], count)])
        rows += [(*divmod(p, len(size)), 1) for p in pairs.tolist()]
    return tuple(np.array(rows, dtype=np.int64).reshape(-1, 3).T)


def _search(items_of, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of.value
        maybe = _filter(items.sketch)
        for batch in batches:
            for part in slices(batch, "text"):
                d, i, shared = find(items, maybe, part["text"], n)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"].take(pa.array(d)), pa.array(items.ids[i], mask=items.null_id[i]),
                    pa.array(shared, pa.int32()), pa.array(items.sizes[i], pa.int32()),
                ], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return run


def _without(items_of, n: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of.value
        maybe = _filter(items.sketch)
        for batch in batches:
            for part in slices(batch, at):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[find(items, maybe, part.column(at), n)[0]] = False
                yield part.filter(pa.array(keep))

    return run


def _item_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch["text"])
            hashes, _, first = grams(words, n, short_as_one=True)
            sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            few = np.where(words.counts < n, words.counts, 0)
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(sets, pa.binary()), pa.array(few, pa.int32())], names=["item_id", "shingles", "words"])

    return run


def item_blocks(benchmark: DataFrame, n: int, threshold: float) -> Iterator:
    """Broadcast blocks of items."""
    spark = benchmark.sparkSession
    ship(spark)
    items = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")
    sets = checkpoint(items.mapInArrow(lean_map(_item_sets(n)), "item_id long, shingles binary, words int").where("length(shingles) > 0"))
    total = sets.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    blocks = int(-(-total // BLOCK_SHINGLES))
    sets = sets.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, blocks))))
    for b in range(blocks):
        rows = sets.where(F.col("block") == b).select("item_id", "shingles", "words").collect()
        if rows:
            yield spark.sparkContext.broadcast(make_items([tuple(r) for r in rows], threshold))


def contained_items(documents: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) of each document and each item that it contains."""
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [docs.mapInArrow(lean_map(_search(items, n)), _PAIR) for items in item_blocks(benchmark, n, threshold)]
    return reduce(DataFrame.union, found) if found else documents.sparkSession.createDataFrame([], _PAIR)


def without_items(documents: DataFrame, benchmark: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that contain no item; nothing is shuffled."""
    kept = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))
    for items in item_blocks(benchmark, n, threshold):
        kept = kept.mapInArrow(lean_map(_without(items, n, documents.columns.index("text"))), kept.schema)
    return kept.toDF(*documents.columns)
