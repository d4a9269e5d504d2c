"""Quality scores: kernel ridge regression by random Fourier features, with isotonic calibration.

Each whole text becomes a few statistics of its words, characters and lines.
Standardised, they are mapped to ``FEATURES`` random Fourier features, whose
inner products approximate a Gaussian kernel.  Each partition of labelled rows
sums its part of the normal equations; the sums are small, are added some at a
time in a tree and solved on the driver.  Scores of other labelled rows, in
bins, give an isotonic curve that turns a score into the share of label 1 (with
half a row of each label more): it rises from block to block.

All labelled rows whose crc32 of the id leaves 0 or 1 when divided by 4 fit
the ridge, those that leave 3 the curve; the rest are held out.  Statistics
are made once and checkpointed; texts are not shuffled.

Nulls: a null text is empty; a null quality is no label; a null doc_id is in
the split as the empty text and has no label.  Repeated rows and labels count
each time.  Ties: rows of one raw score have one score.  Extra columns and
columns whose names differ in case only are left out.  Empty texts have statistics too (zeros).  With no label of one
of the two kinds, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.language_id import held_out
from basketlens.llm.runtime import checkpoint, combined, lean_map, pick, ship
from basketlens.llm.words import U, Words, mix, slices, words_of

FEATURES = 256
RIDGE = 1e-3
PASS = 0.7
BINS = 1000  # of raw scores between -1 and 2
STATISTICS = (
    "log_words", "word_bytes", "upper", "symbols", "digits", "distinct", "repeated_next", "no_letter",
    "ends_punctuated", "log_line_words", "repeated_lines", "capitalised", "exclamations", "bars", "top_word",
)

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 other
_KIND[33:127] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[128:] = 2


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def line_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of each line that has a word; equal lines of a text have equal keys, by their bytes."""
    data, n = words.data, len(words.data)
    last = np.zeros(n, dtype=bool)
    last[words.text_end - 1] = True  # the space added after each text
    end = np.flatnonzero((data == 10) | last)
    start = np.concatenate([[0], end[:-1] + 1])
    key = words.span_hashes(start, end)
    text = np.searchsorted(words.text_end, start, "right")
    filled = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, start)
    return text[filled], key[filled]


def repeats(text: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """In each text, how many keys equal an earlier one."""
    _, first = np.unique(mix(key ^ mix(text.astype(U), 0x21)), return_index=True)
    return np.bincount(text, minlength=texts) - np.bincount(text[first], minlength=texts)


def statistics(texts: pa.Array) -> np.ndarray:
    """STATISTICS of each text, a row each."""
    words = words_of(texts)
    n, count = len(words.counts), words.counts.astype(np.float64)
    out = np.zeros((n, len(STATISTICS)))
    if not len(words.starts):
        return out
    some = np.maximum(count, 1)
    data, bounds = words.data, np.concatenate([[0], words.text_end])
    kind = _KIND[data]
    kinds = [_sums(kind == k, bounds) for k in range(1, 5)]
    size = np.maximum(sum(kinds), 1)
    hashes = words.hashes()
    text = np.repeat(np.arange(n), words.counts)
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    key, first, number = np.unique(mix(hashes ^ mix(text.astype(U), 0x21)), return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, text[first], number)
    line_text, line_key = line_keys(words)
    lines = np.maximum(np.bincount(line_text, minlength=n), 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p(size / some)
    out[:, 2] = kinds[0] / np.maximum(kinds[0] + kinds[1], 1)
    out[:, 3] = kinds[3] / size
    out[:, 4] = kinds[2] / size
    out[:, 5] = np.log(np.maximum(np.bincount(text[first], minlength=n), 1)) / np.maximum(np.log(some + 1), 1)
    out[:, 6] = _sums(same, words.first) / some
    out[:, 7] = _sums(letters[words.ends] == letters[words.starts], words.first) / some
    out[:, 8] = _sums(np.isin(data[words.ends - 1], np.frombuffer(b".,;:!?", np.uint8)), words.first) / some
    out[:, 9] = np.log1p(count / lines)
    out[:, 10] = repeats(line_text, line_key, n) / lines
    out[:, 11] = _sums(kind[words.starts] == 1, words.first) / some
    out[:, 12] = _sums(data == ord("!"), bounds) / some
    out[:, 13] = _sums(data == ord("|"), bounds) / some
    out[:, 14] = top / some
    out[count == 0] = 0
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            x = statistics(part["text"])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.turn + self.phase
        return np.concatenate([np.sqrt(2 / z.shape[1]) * np.cos(z), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weight, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.share), 0, 1)


def _part_sums(scorer: Scorer | None):
    """One row, the sums of the normal equations; without a scorer the sums of x and x**2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch["x"]), batch["y"].to_numpy()
            if scorer is None:
                own = np.stack([np.append(x.sum(0), len(x)), np.append((x**2).sum(0), y.sum())])
            else:
                z = scorer.features(x)
                own = np.concatenate([z.T @ z, (z.T @ y)[None, :]])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _added(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p) for p in parts], axis=0).tobytes()


def _summed(rows: DataFrame, scorer: Scorer | None) -> np.ndarray | None:
    total = combined(rows.mapInArrow(lean_map(_part_sums(scorer)), "part binary"), rows.rdd.getNumPartitions(), _added)
    return None if total is None else np.frombuffer(total).reshape(-1, len(STATISTICS) + 1 if scorer is None else FEATURES + 1)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares of y (sums over n) by x: centres of the blocks and their shares.

    Shares are those of the block with half a row of each label more; blocks
    are joined until these rise, so a small block at the end cannot fall.
    """
    blocks: list[list[float]] = []
    share = lambda block: (block[1] + 0.5) / (block[2] + 1)
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b, c])
        while len(blocks) > 1 and share(blocks[-2]) >= share(blocks[-1]):
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([share(b) for b in blocks])


def _raw_scores(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["y"], pa.array(scorer.raw(_matrix(batch["x"])))], names=["y", "raw"])

    return run


def fit(described: DataFrame, labels: DataFrame, seed: int = 17) -> Scorer:
    """Scorer from (doc_id, x) and (doc_id, quality)."""
    y = pick(labels, "doc_id", "quality").where("quality is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    known = described.join(y, "doc_id").select("x", "y", (F.crc32(F.col("doc_id").cast("string")) % 4).alias("fold")).where("fold != 2")
    known = checkpoint(known)
    fitted = known.where("fold != 3")
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    turn, phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    empty = Scorer(np.zeros(d), np.ones(d), turn, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    moments = _summed(fitted, None)
    if moments is None:
        return empty
    n, positive = moments[0, d], moments[1, d]
    mean = moments[0, :d] / n
    scale = np.sqrt(np.maximum(moments[1, :d] / n - mean**2, 1e-6))
    scorer = Scorer(mean, scale, turn, phase, empty.weight, np.array([0.0]), np.array([positive / n]))
    if positive in (0, n):
        return scorer
    sums = _summed(fitted, scorer)
    scorer.weight = np.linalg.solve(sums[:-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), sums[-1])
    bins = known.where("fold = 3").mapInArrow(lean_map(_raw_scores(scorer)), "y double, raw double")
    bins = bins.groupBy(F.round(F.col("raw") * BINS / 3).alias("bin")).agg(F.avg("raw").alias("raw"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        scorer.knots, scorer.share = pool_adjacent(*(np.array([float(r[c]) for r in bins]) for c in ("raw", "y", "n")))
    return scorer


def _score(scorer_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = scorer_of.value.score(_matrix(batch["x"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    spark = documents.sparkSession
    ship(spark)
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = checkpoint(docs.mapInArrow(lean_map(_describe), "doc_id long, x binary"))
    scorer = spark.sparkContext.broadcast(fit(described, labels))
    scored = described.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(lean_map(_score(scorer)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= PASS).cast("int"))
