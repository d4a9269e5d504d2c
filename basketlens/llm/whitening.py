"""Whitening of embeddings by the singular value decomposition of their centred rows.

Entries become whole numbers x = floor(64 c) + 1000000.  The fit list holds
each distinct x vector once (grouped by its bytes, so a vector that a third
of the rows share is one row after the map side).  Each partition reduces its
centred rows, block by block, to one triangle by QR; triangles are joined by
QR again, ``FAN`` at a time.  The last one is bidiagonalised, dqds gives its
singular values and twisted factorisations its directions (``qd``).  With n
vectors, the eigenvalues of the covariance are the squared singular values
over n; the covariance itself is never formed.

Every covariance is over the fit list, with divisor n, centred first.
``deviation`` is exact: n x - S in whole numbers, squared and summed (null
where the sum is beyond 2^63 - 1).

Nulls: rows whose vector is null or empty or has a null or non-finite entry
are left out; a null vec_id stays.  Rows whose vector has another length than
the most frequent one (the shorter of equally frequent ones) are left out.
Entries beyond 2^44 count as that.  Repeated rows are returned each and
fitted once.  Directions without variance are no components: fewer than two
distinct vectors, or an empty table, give no rows.  Ties: components of equal
eigenvalues may be any basis of their space, the same for all rows.  Extra
columns and names that differ in case only are left out.

The d x d triangle and the d x 16 directions are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.qd import right_singular
from basketlens.llm.runtime import checkpoint, combined, lean_map, pick, ship

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 50  # of 64 c
COMPONENTS = 16
BLOCK_ENTRIES = 1 << 18
_WIDTHS = (2, 4, 8)
_WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes, entries in the fewest of 2, 4 and 8 bytes that hold them all; equal rows have equal bytes."""
    most = np.maximum(x.max(axis=1), -1 - x.min(axis=1)) if x.shape[1] else np.zeros(len(x), np.int64)
    width = np.select([most < 1 << 15, most < 1 << 31], _WIDTHS[:2], _WIDTHS[2])
    parts, at = [], []
    for w in _WIDTHS:
        rows = np.flatnonzero(width == w)
        if len(rows):
            data = pa.py_buffer(x[rows].astype(f"<i{w}").tobytes())
            parts.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(w * x.shape[1]), len(rows), [None, data]).cast(pa.binary()))
            at.append(rows)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(at)))) if parts else pa.array([], pa.binary())


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The x vectors of packed rows."""
    out = np.empty((len(column), d), dtype=np.int64)
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for w in _WIDTHS:
        rows = np.flatnonzero(size == w * d)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(column.take(pa.array(rows)).to_pylist()), f"<i{w}").reshape(-1, d)
    return out + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK_ENTRIES // d)
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, _unpacked(part["x"], d)


def _quantise(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_ENTRIES // d)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part["vector"]), d), False))
                v = pc.list_flatten(part["vector"]).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
                finite = np.isfinite(v).all(axis=1)  # a null entry is NaN here
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * v[finite]), -LARGEST, LARGEST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part["vec_id"].filter(pa.array(finite)), _packed(x)], names=["vec_id", "x"])

    return run


def quantised(embeddings: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """((vec_id, x) of the usable rows, x packed; length of a vector)."""
    ship(embeddings.sparkSession)
    rows = pick(embeddings, "vec_id", column).toDF("vec_id", "vector").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    d = rows.where("vector is not null and cardinality(vector) > 0").agg(F.mode(F.size("vector"), True)).first()[0] or 1
    return rows.mapInArrow(lean_map(_quantise(d)), "vec_id long, x binary"), d


def _one_part(batches: Iterator[pa.RecordBatch], d: int, add) -> Iterator[pa.RecordBatch]:
    """One row for a partition: what is left after ``add`` took in each block."""
    state = None
    for _, x in _blocks(batches, d):
        if len(x):
            state = add(state, x)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], names=["part"])


def _sums(d: int):
    def add(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        own = np.append(x.sum(axis=0), len(x))
        return own if state is None else state + own

    return lambda batches: _one_part(batches, d, add)


@dataclass
class Centre:
    """n vectors of sums S; S / n as a whole part and a rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        y = x - self.whole
        if x.shape[1] * (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the QR factorisation, as a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.concatenate([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _triangles(d: int, centre: Centre):
    def add(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        rows = centre.rows(x)
        return _triangle(rows if state is None else np.concatenate([state, rows]))

    return lambda batches: _one_part(batches, d, add)


def _moments(y: np.ndarray) -> np.ndarray:
    """(count, means, centred products) in one vector."""
    mean = y.mean(axis=0)
    return np.concatenate([[len(y)], mean, ((y - mean).T @ (y - mean)).ravel()])


def _joined_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2)
    n, gap = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    mean = a[1 : k + 1] + gap * (b[0] / n)
    return np.concatenate([[n], mean, a[k + 1 :] + b[k + 1 :] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)])


@dataclass
class Whitening:
    d: int
    centre: Centre
    values: np.ndarray  # eigenvalues of the components
    turn: np.ndarray  # directions over their standard deviations, as columns
    explained: np.ndarray
    identity_error: float = 0.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.turn


def _part_moments(model: Whitening):
    def add(state: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        own = _moments(model.rows(x))
        return own if state is None else _joined_moments(state, own)

    return lambda batches: _one_part(batches, model.d, add)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Model of the distinct x of (vec_id, x); None where nothing varies."""
    distinct = checkpoint(rows.select("x").distinct())
    partitions = distinct.rdd.getNumPartitions()

    def over(run, join):
        return combined(distinct.mapInArrow(lean_map(run), "part binary"), partitions, join)

    def added(parts: list[bytes]) -> bytes:
        return sum(np.frombuffer(p, np.int64) for p in parts).tobytes()

    def stacked(parts: list[bytes]) -> bytes:
        return _triangle(np.concatenate([np.frombuffer(p).reshape(d, d) for p in parts])).tobytes()

    def pooled(parts: list[bytes]) -> bytes:
        total = np.frombuffer(parts[0])
        for p in parts[1:]:
            total = _joined_moments(total, np.frombuffer(p))
        return total.tobytes()

    sums = over(_sums(d), added)
    if sums is None:
        return None
    total = np.frombuffer(sums, np.int64)
    n = int(total[-1])
    centre = Centre(n, total[:-1] // n, total[:-1] % n)
    squares, directions = right_singular(np.frombuffer(over(_triangles(d, centre), stacked)).reshape(d, d), components)
    k = directions.shape[1]
    if not k:
        return None
    values = squares[:k] / n
    model = Whitening(d, centre, values, directions / np.sqrt(values), squares[:k] / squares.sum())
    moments = np.frombuffer(over(_part_moments(model), pooled))
    model.identity_error = float(np.abs(moments[k + 1 :].reshape(k, k) / n - np.eye(k)).max())
    return model


def _whiten(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for part, x in _blocks(batches, model.d):
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                part["vec_id"].take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), model.centre.n)),
                pa.array(model.centre.deviation(x), pa.int64()).take(row), pa.array(model.rows(x).ravel()), pa.array(np.tile(model.explained, len(x))),
                pa.array(np.full(len(row), model.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row of each usable vector and component."""
    rows, d = quantised(embeddings, column)
    model = fit(rows, d, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _WHITENED)
    return rows.mapInArrow(lean_map(_whiten(model)), _WHITENED)
