"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Shingles are runs of ``n`` words; a text of fewer words has one shingle, all
its words; a text without words has none and joins nothing.  Two documents
are linked if the Jaccard similarity of their shingle sets is at least
``threshold``.

1. Documents with the same shingle set are one class, known by a hash of the
   set; one document of it is compared.
2. Each has ``HASHES`` MinHash values, in bands of as many as keep the chance
   that a pair at the threshold shares no band below ``MISS`` (at 0.8: 32
   bands of 5, 3e-6; a pair at 0.9: 1e-12).  Those that share all values of
   a band meet in a bucket.
3. In a bucket, the values of a pair are compared ``STEP`` at a time.  After
   m equal ones of k, the similarity has (with a uniform prior) a
   Beta(m + 1, k - m + 1) distribution; the pair is dropped as soon as its
   chance to reach the threshold is below ``TOLERANCE``.  One byte of each
   value is compared, so different values are equal in one of 256 cases: a
   few more pairs go on, none is dropped sooner.
4. What survives is gathered into candidate groups (components), and in a
   group the exact similarity of all pairs is computed from the shingles.

No pair is ever a row: buckets send each member's root, groups each member's
number of links and its root.  A bucket or group of more than ``BLOCK``
members is split into blocks, and each pair of blocks is a task's work, so
memory stays bounded while no link is lost.

Nulls: a null text has no shingles.  A null doc_id counts as a negative number
made from the document's shingles.  Repeated rows are copies of one another;
rows of one doc_id with different texts are documents of their own, which share
a class only if links join them.  Ties: of documents with equal ids the smaller
hash of id and text comes first.  An empty table gives no rows.  Extra columns
and columns whose names differ in case only are left out (``one_of_each``
returns them).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.graph import components, local_components
from basketlens.llm.runtime import checkpoint, lean_map, pick, ship
from basketlens.llm.words import U, grams, mix, slices, words_of

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 160
MISS = 1e-5  # chance for a pair at the threshold to share no band
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256

_SEEDS = np.random.default_rng(813).integers(0, 2**32, (2, HASHES), dtype=np.uint32)
_SEEDS[1] |= 1


def enough_matches(threshold: float, hashes: int, step: int, tolerance: float) -> list[tuple[int, int]]:
    """(k, least number of equal values among the first k with which a pair goes on).

    P(similarity >= t | m of k equal) = P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(step, hashes + 1, step):
        total, least = 0.0, k + 1
        for m in range(k + 1):
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                least = m
                break
        out.append((k, least))
    return out


def rows_a_band(threshold: float) -> int:
    """Most values a band may have for a chance of at most MISS to lose a pair at the threshold."""
    good = [r for r in range(1, 11) if (1 - threshold**r) ** (HASHES // r) <= MISS]
    if not good:
        raise ValueError(f"a threshold of {threshold} needs more than {HASHES} hashes")
    return max(good)


def minhashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values of each set (rows x values, 16 mixed bits each); 0 for an empty set."""
    sets = len(first) - 1
    out = np.zeros((sets, HASHES), dtype=np.uint16)
    full = np.flatnonzero(np.diff(first) > 0)
    part = (first[full] // (1 << 15)).astype(np.int64)
    x = (hashes >> U(32)).astype(np.uint32)
    for own in np.split(full, np.flatnonzero(np.diff(part)) + 1):  # parts that fit the cache
        if len(own) == 0:
            continue
        values, at = x[first[own[0]] : first[own[-1] + 1]], first[own] - first[own[0]]
        for k in range(HASHES):
            low = np.minimum.reduceat((values ^ _SEEDS[0, k]) * _SEEDS[1, k], at)
            out[own, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


_SIGNED = "doc_id long, key long, s1 long, s2 long, n int, sig binary"


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, first = grams(words_of(part["text"]), n, short_as_one=True)
                size = np.zeros(part.num_rows, dtype=np.int32)
                both = np.zeros((part.num_rows, 2), dtype=U)
                for i in np.flatnonzero(np.diff(first)):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    size[i] = len(own)
                    with np.errstate(over="ignore"):
                        both[i] = mix(own, 1).sum(dtype=U), mix(own, 2).sum(dtype=U)
                sig = minhashes(hashes, first)
                # all low bytes, then all high bytes
                sig = np.concatenate([(sig & 0xFF).astype(np.uint8), (sig >> 8).astype(np.uint8)], axis=1)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], part["key"], pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64)),
                    pa.array(size), pa.array([x.tobytes() for x in sig], pa.binary()),
                ], names=["doc_id", "key", "s1", "s2", "n", "sig"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        new = group_starts(table, keys)
        last = int(new[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
        held, count = rest.to_batches(), rest.num_rows
        most = max(most, 2 * count)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = table[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _pairs(starts: np.ndarray, sizes: np.ndarray, side: np.ndarray, cross: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs i < j inside each group, some at a time; a cross group pairs its two sides only."""
    length = np.repeat(starts + sizes, sizes)  # the end of each row's group
    row = np.arange(len(length))
    after = length - row - 1
    cuts = np.concatenate([[0], np.cumsum(after)])
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + most, "right")) - 1)
        i = np.repeat(row[a:b], after[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(cuts[a:b] - cuts[a], after[a:b])
        keep = ~cross[i] | (side[i] != side[j])
        yield i[keep], j[keep]
        a = b


def _prune(threshold: float):
    tests = enough_matches(threshold, HASHES, STEP, TOLERANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["bucket", "lo", "hi"]):
            starts = group_starts(table, ["bucket", "lo", "hi"])
            sizes = np.diff(np.append(starts, table.num_rows))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
            cross = table["lo"].to_numpy() != table["hi"].to_numpy()
            a, b = [], []
            for i, j in _pairs(starts, sizes, table["block"].to_numpy(), cross):
                equal, done = np.zeros(len(i), dtype=np.int32), 0
                for k, least in tests:
                    equal += (sig[i, done:k] == sig[j, done:k]).sum(axis=1, dtype=np.int32)
                    on = equal >= least
                    i, j, equal, done = i[on], j[on], equal[on], k
                a.append(i)
                b.append(j)
            node = table["node"].to_numpy()
            # one edge a row and its root: the smallest row of its component here
            root = local_components(np.concatenate(a), np.concatenate(b), len(node)) if a else np.arange(len(node))
            own = node != node[root]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root][own])], names=["a", "b"])

    return run


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, first = grams(words_of(part["text"]), n, short_as_one=True)
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def overlaps(sets: list[np.ndarray], most: int = 1 << 24) -> np.ndarray:
    """Sizes of all intersections, from blocks of a 0/1 matrix of bounded size."""
    m = len(sets)
    member = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((m, m), dtype=np.int64)
    width = max(1, most // max(1, m))
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    for a in range(0, len(values), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        dense = np.zeros((m, min(width, len(values) - a)), dtype=np.float32)
        dense[member[lo:hi], column[lo:hi] - a] = 1
        out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _verify(threshold: float):
    num, den = round(threshold * 10**6), 10**6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["comp", "lo", "hi"], 1024):
            starts = group_starts(table, ["comp", "lo", "hi"])
            node, copies, block = (table[c].to_numpy() for c in ("node", "copies", "block"))
            cross = table["lo"].to_numpy() != table["hi"].to_numpy()
            sets = [np.frombuffer(x, U) for x in table["shingles"].to_pylist()]
            texts, docs, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), node.copy()
            for s, e in zip(starts, np.append(starts[1:], len(node)), strict=True):
                size = np.array([len(x) for x in sets[s:e]])
                inter = overlaps(sets[s:e])
                union = size[:, None] + size[None, :] - inter
                linked = (inter * den >= union * num) & ~np.eye(e - s, dtype=bool)
                if cross[s]:
                    linked &= block[s:e, None] != block[None, s:e]
                texts[s:e] = linked.sum(axis=1)
                docs[s:e] = linked @ copies[s:e]
                root[s:e] = node[s:e][local_components(*np.nonzero(linked), int(e - s))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, texts, docs, root)], names=["node", "texts", "docs", "root"])

    return run


def _blocked(members: DataFrame, size: str, key: str) -> DataFrame:
    """Members with their block and the pairs of blocks (lo, hi) they go to; one pair if the group fits a block."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(11)), blocks).cast("int")
    pairs = members.withColumns({"blocks": blocks, "block": block}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return pairs.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks", size)


def similar_documents(documents: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, same_id, class_id, n_links, n_linked_texts, row_key, class_key).

    ``same_id``: smallest doc_id with the same shingle set.  ``class_id``: the
    smallest doc_id that can be reached over links.  ``n_links``: other
    documents at the threshold or above, copies counted;
    ``n_linked_texts``: those of other shingle sets, each set once.
    ``row_key``: hash of doc_id and text; ``class_key``: of the class, also
    where ids repeat.
    """
    ship(documents.sparkSession)
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    signed = checkpoint(docs.mapInArrow(lean_map(_sign(n)), _SIGNED))
    signed = signed.withColumn("own", F.coalesce("doc_id", -F.abs(F.shiftright("s1", 1)) - 1))
    least = F.min(F.struct("own", "key", "doc_id"))
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(least.alias("of"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = checkpoint(classes.select("s1", "s2", "copies", "sig", F.xxhash64("s1", "s2").alias("node"), F.col("of.own").alias("least_id"), F.col("of.key").alias("key"), F.col("of.doc_id").alias("doc_id")))

    rows = rows_a_band(threshold)
    band = F.explode(F.sequence(F.lit(0), F.lit(HASHES // rows - 1)))
    values = [F.expr(f"substring(sig, {plane * HASHES} + band * {rows} + 1, {rows})") for plane in (0, 1)]
    keyed = classes.select("node", "sig", band.alias("band")).select("node", F.xxhash64("band", *values).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = keyed.join(sizes, "bucket")
    met = _blocked(met, "size", "bucket").join(classes.select("node", F.expr(f"substring(sig, 1, {HASHES})").alias("sig")), "node")
    met = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")
    edges = met.mapInArrow(lean_map(_prune(threshold)), "a long, b long")
    groups = components(edges)

    sized = checkpoint(groups.join(groups.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", F.col("root").alias("comp"), "size"))
    members = sized.join(classes.select("node", "copies", "key", "doc_id"), "node")
    same = (docs["key"] == members["key"]) & docs["doc_id"].eqNullSafe(members["doc_id"])
    texts = docs.join(members, same).select("node", "text").dropDuplicates(["node"])
    named = texts.mapInArrow(lean_map(_shingle_sets(n)), "node long, shingles binary")
    members = members.select("node", "comp", "size", "copies")
    blocks = _blocked(members, "size", "comp").join(named, "node")
    blocks = blocks.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "node")
    verified = checkpoint(blocks.mapInArrow(lean_map(_verify(threshold)), "node long, texts long, docs long, root long"))
    linked = verified.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(verified.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))

    named_roots = roots.join(classes.select("node", "least_id"), "node").groupBy("root").agg(F.min("least_id").alias("root_id"))
    roots = roots.join(named_roots, "root")
    found = classes.select("s1", "s2", "node", "copies", "least_id").join(linked, "node", "left").join(roots, "node", "left")
    out = signed.join(found, ["s1", "s2"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id",
        F.coalesce("least_id", "own").alias("same_id"),
        F.coalesce("root_id", "least_id", "own").alias("class_id"),
        (F.coalesce(F.col("copies") - 1, zero) + F.coalesce("docs", zero)).alias("n_links"),
        F.coalesce("texts", zero).alias("n_linked_texts"),
        signed["key"].alias("row_key"),
        F.coalesce("root", "node", signed["key"]).alias("class_key"),
    )


def one_of_each(documents: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns: of each class that of the smallest doc_id."""
    found = similar_documents(documents, n, threshold)
    first = found.groupBy("class_key").agg(F.min(F.struct(F.coalesce("doc_id", "same_id"), "row_key"))["row_key"].alias("row_key"))
    names = [f"c{i}" for i in range(len(documents.columns))]
    docs = documents.toDF(*names)
    doc_id, text = (names[documents.columns.index(c)] for c in ("doc_id", "text"))
    docs = docs.withColumn("row_key", F.xxhash64(F.col(doc_id).cast("long"), text))
    return docs.join(first, "row_key", "left_semi").dropDuplicates(["row_key"]).drop("row_key").toDF(*documents.columns)
