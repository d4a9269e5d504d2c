from fractions import Fraction
from math import floor, inf, isfinite, nan

import numpy as np
import pytest

from basketlens.llm import qd, runtime
from basketlens.llm import whitening as wh
from basketlens.llm.queries import op13_embedding_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, d):
    """(usable (vec_id, x), n, S, covariance) in whole numbers and fractions."""
    usable = [(i, tuple(floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v is not None and len(v) == d and all(c is not None and isfinite(c) for c in v)]
    fit = sorted({x for _, x in usable})
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * a - b for a, b in zip(x, s)] for x in fit], dtype=object)
    cov = (centred.T @ centred) if n else None
    return usable, n, s, cov


def agree(got, rows, d, most=16, places=9):
    usable, n, s, cov = brute_force(rows, d)
    v = np.array([[float(Fraction(int(c), n**3)) for c in r] for r in cov])
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((e > e[0] * 1e-20).sum()), len({r.component for r in got}))
    table = {}
    for r in got:
        table.setdefault(r.component, []).append(r)
    assert sorted(table) == list(range(1, k + 1)) and all(len(t) == len(usable) for t in table.values())
    exact = ((str(i), sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in usable)
    want = sorted((i, n, y if y < 2**63 else None) for i, y in exact)
    for c, t in table.items():
        assert sorted((str(r.vec_id), r.n, r.deviation) for r in t) == want
        assert {r.explained for r in t} == {t[0].explained} and abs(t[0].explained / (e[c - 1] / np.trace(v)) - 1) < 1e-8
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    # The whitened rows, over the fit list, give back the directions: they are unit eigenvectors of the covariance.
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r.whitened
    fit = {x: by_id[i] for i, x in usable}
    x = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(key, s)] for key in fit])
    y = np.array([[w[c] for c in range(1, k + 1)] for w in fit.values()])
    turn = np.linalg.lstsq(x, y, rcond=None)[0] * np.sqrt(e[:k])
    assert np.abs(v @ turn - turn * e[:k]).max() < 10.0**-places * e[0]
    assert np.abs(turn.T @ turn - np.eye(k)).max() < 10.0**-places
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-6


def test_literal_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [3, 1, 1, 0.5, 0.2]]) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (99, None), (100, []), (101, [1.0] * 4), (102, [1.0, 2.0, None, 0.0, 1.0]), (103, [1.0, nan, 0.0, 0.0, 1.0]), (104, [inf] * 5), (105, [-inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    agree(wh.whiten(df).collect(), rows, 5)
    assert {r.component for r in wh.whiten(df, components=2).collect()} == {1, 2}
    clashing = df.selectExpr("embedding", "1 as x", "2 as VEC_ID", "vec_id", "3 as Embedding", "4 as n").repartition(5)
    agree(wh.whiten(clashing).collect(), rows, 5)
    assert wh.whiten(df.limit(0)).collect() == [] and wh.whiten(df.limit(0)).dtypes == wh.whiten(df).dtypes


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None), (2, [nan])]])
def test_nothing_varies(spark, rows):
    assert wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_rank_below_the_length(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 7) * 2, 1.0]) for i in range(40)]
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2}
    assert got[0].identity_error < 1e-9


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [float(10 * (1 - 2 * s)) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (0, 1)]
    agree(wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 6)


def test_large_and_small_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [3.0, -1e9]), (4, [5e4, 600.0]), (5, [0.015, 0.0])]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2}
    assert next(r.deviation for r in got if r.vec_id == 1) is None
    agree(wh.whiten(spark.createDataFrame(rows[1:], "vec_id long, embedding array<double>")).collect(), rows[1:], 2, places=6)


def test_hot_vector_and_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(runtime, "FAN", 2)
    monkeypatch.setattr(wh, "BLOCK_ENTRIES", 64)
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in (rng.normal(size=6) if i % 3 else np.ones(6))]) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        agree(wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 6)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = op13_embedding_whitening(spark, SF)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    agree(df.collect(), rows, 64)


def solved(a, most=16):
    r = np.linalg.qr(a, mode="r")
    r = np.concatenate([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])
    squares, w = qd.right_singular(r, most)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(squares - want).max() <= 1e-13 * want[0]
    assert np.abs(a.T @ a @ w - w * squares[: w.shape[1]]).max(initial=0) <= 1e-12 * want[0]
    assert np.abs(w.T @ w - np.eye(w.shape[1])).max(initial=0) <= 1e-10
    return squares, w


RNG = np.random.default_rng(4)
MATRICES = {
    "square": RNG.normal(size=(300, 40)), "falling": RNG.normal(size=(300, 30)) * 10.0 ** -np.arange(30).clip(0, 12), "identity": np.eye(20),
    "low rank": RNG.normal(size=(90, 3)) @ RNG.normal(size=(3, 20)), "twice": np.kron(np.eye(2), RNG.normal(size=(60, 12))), "fewer rows": RNG.normal(size=(4, 12)),
    "nearly equal": np.eye(24) + 1e-13 * RNG.normal(size=(24, 24)), "zero": np.zeros((5, 6)), "one": RNG.normal(size=(9, 1)), "two": RNG.normal(size=(9, 2)),
    "some zero": np.diag(np.r_[np.ones(6), np.zeros(6)]), "whole": RNG.integers(-3, 4, size=(80, 32)).astype(float), "graded": np.triu(RNG.normal(size=(30, 30))) * 10.0 ** -np.arange(30)[:, None],
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_directions(name):
    solved(MATRICES[name])


def test_any_whole_numbers_converge():
    rng = np.random.default_rng(6)
    for _ in range(150):
        m, d = rng.integers(1, 14, 2)
        a = rng.integers(-2, 3, (m, d)) * rng.choice([0.0, 1.0, 1.0, 1e6, 1e-9], d)
        if rng.random() < 0.3:
            a[:, rng.integers(d)] = a[:, 0]
        solved(a.astype(float))


def test_small_values_are_relatively_accurate():
    diagonal = 10.0 ** -np.arange(0.0, 120, 10)
    values = qd.dqds(diagonal, np.zeros(11))
    assert np.abs(values / diagonal**2 - 1).max() < 1e-14
    # Of a bidiagonal matrix with tiny entries: the product of all values is that of the diagonal.
    above = diagonal[1:] * 0.5
    assert abs(np.sum(np.log(qd.dqds(diagonal, above))) / np.sum(np.log(diagonal**2)) - 1) < 1e-14
