"""Best-fit packing: documents into sequences of at most ``CAPACITY`` tokens.

Each document is its token ids and one id 1 that ends it.  Only longer ones
are cut, into pieces of ``CAPACITY`` tokens, the last as long as what is left.

Pieces are dealt by hash to shards of bounded size; a shard loses less than
one sequence against packing all pieces at once.  In a shard, best-two-fit:
a sequence takes the largest unpacked piece, then again and again the largest
that fits its gap; when none fits and there is a gap, its smallest piece is
given back for the two unpacked pieces that fit the widened gap most tightly,
if they fill more of it.

Nulls: a null text is empty, one token long; a null doc_id stays.  Repeated
rows are packed each.  An empty table gives no rows.  Ties: pieces of one length
are taken in order of doc_id and piece.  Extra columns and columns whose names
differ in case only are left out.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import lean_group, lean_map, pick, ship
from basketlens.llm.tokens import spread, word_tokens
from basketlens.llm.words import slices, words_of

CAPACITY = 4096
END = 1
SHARD_BYTES = 16 << 20  # of text a shard

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in it) of each length (1 to capacity)."""
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    stacks = {int(s): part.tolist() for s, part in zip(sizes, np.split(order, first[1:]), strict=True)} if len(sizes) else {}
    have = [int(s) for s in sizes]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(size: int) -> tuple[int, int]:
        item = stacks[size].pop()
        if not stacks[size]:
            del have[bisect_left(have, size)]
        return size, item

    number = 0
    while have:
        inside = [take(have[-1])]
        gap = capacity - inside[0][0]
        while gap and have and have[0] <= gap:
            inside.append(take(have[bisect_right(have, gap) - 1]))
            gap -= inside[-1][0]
        if gap and have:
            least, item = min(inside)
            pair = tightest_pair(have, stacks, gap + least)
            if pair and sum(pair) > least:
                inside.remove((least, item))
                inside += [take(pair[0]), take(pair[1])]
                if not stacks[least]:
                    insort(have, least)
                stacks[least].append(item)
        at = 0
        for size, item in inside:
            sequence[item], offset[item] = number, at
            at += size
        number += 1
    return sequence, offset


def tightest_pair(have: list[int], stacks: dict[int, list[int]], room: int) -> tuple[int, int] | None:
    """The two unpacked sizes of the largest sum that is not above ``room``."""
    best, i, j = None, 0, bisect_right(have, room) - 1
    while i <= j:
        total = have[i] + have[j]
        if total > room:
            j -= 1
            continue
        if (i < j or len(stacks[have[i]]) > 1) and (best is None or total > sum(best)):
            best = have[j], have[i]
            if total == room:
                return best
        i += 1
    return best


def _ids(part: pa.RecordBatch, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with its END, and the bounds of each."""
    words = words_of(part["text"])
    cache = word_tokens("tokenizers", tokenizer)
    start, count = cache.of(words)
    ids = cache.pool[spread(start, count)]
    upto = np.concatenate([[0], np.cumsum(count)])[words.first]
    bounds = upto + np.arange(part.num_rows + 1)
    out = np.full(bounds[-1], END, dtype="<u4")
    own = np.ones(len(out), dtype=bool)
    own[bounds[1:] - 1] = False
    out[own] = ids
    return out, bounds


def _cut(tokenizer: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, bounds = _ids(part, tokenizer)
                size = np.diff(bounds)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(part.num_rows), pieces)
                piece = spread(np.zeros(len(pieces), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                at = bounds[:-1][doc] + start
                views = [memoryview(ids[a : a + n]).cast("B") for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array([zlib.crc32(v) for v in views], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([ids[a : a + n].astype(np.int64) for a, n in zip(at, length, strict=True)], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _place(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_two_fit(table["length"].to_numpy(), capacity)
        shard = table["shard"].to_numpy().astype(np.int64)
        placed = table.drop_columns(["shard"])
        return placed.append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column("offset", pa.array(offset))

    return run


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset).

    ``tokenizer``: a file of the ``tokenizers`` library whose tokens never
    span white space.  ``ids_crc32``: of the ids as little-endian unsigned
    32-bit numbers.  ``offset``: where the piece starts in its sequence.
    """
    ship(documents.sparkSession)
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    schema = _PIECE + ", ids array<long>" * with_ids
    pieces = docs.mapInArrow(lean_map(_cut(tokenizer, capacity, with_ids)), schema)
    # with the input partition, so that equal rows without an id are spread too
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(lean_group(_place(capacity)), schema + ", sequence_id long, offset long")
