import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import quality
from basketlens.llm.quality import STATISTICS, Scorer, pool_adjacent, score_quality, statistics

SF = "/root/testdata/sf0.1"


def test_statistics():
    x = dict(zip(STATISTICS, statistics(pa.array(["Ab cd, cd, 12\nx | !\nx | !", "", None, "\n \n", "é É é"])).T, strict=True))
    assert x["log_words"].tolist() == pytest.approx([np.log(11), 0, 0, 0, np.log(4)])
    assert x["upper"][0] == pytest.approx(1 / 8) and x["digits"][0] == pytest.approx(2 / 16)
    assert x["repeated_next"][0] == pytest.approx(0.1) and x["no_letter"][0] == pytest.approx(0.5)
    assert x["repeated_lines"].tolist() == pytest.approx([1 / 3, 0, 0, 0, 0])
    assert x["top_word"][0] == pytest.approx(0.2) and x["bars"][0] == pytest.approx(0.2)


def test_isotonic_blocks():
    x, y = pool_adjacent(np.arange(5.0), np.array([1.0, 0, 3, 2, 4]), np.array([4.0, 4, 4, 4, 4]))
    assert y.tolist() == pytest.approx([1.5 / 9, 5.5 / 9, 4.5 / 5]) and x.tolist() == pytest.approx([0.5, 2.5, 4])


def test_isotonic_curve_rises():
    x, y = pool_adjacent(np.arange(3.0), np.array([0.0, 900, 1]), np.array([100.0, 1000, 1]))
    assert (np.diff(y) > 0).all()
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(1, 50, 30).astype(float)
        x, y = pool_adjacent(np.arange(30.0), rng.binomial(n.astype(int), rng.random(30)).astype(float), n)
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and 0 < y.min() and y.max() < 1


def plain_statistics(text):
    """The statistics of one text, by loops over its words and characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * len(STATISTICS)
    raw = b"".join(w.encode() for w in words)
    upper, lower = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 or b > 127 for b in raw)
    digits, other = sum(48 <= b < 58 for b in raw), sum(33 <= b < 127 and not chr(b).isalnum() for b in raw)
    size, n = upper + lower + digits + other, len(words)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    letter = lambda w: any(65 <= b < 91 or 97 <= b < 123 or b > 127 for b in w.encode())
    return [
        math.log1p(n), math.log1p(size / n), upper / max(upper + lower, 1), other / max(size, 1), digits / max(size, 1),
        math.log(max(len(set(words)), 1)) / max(math.log(n + 1), 1), sum(a == b for a, b in zip(words, words[1:])) / n, sum(not letter(w) for w in words) / n,
        sum(w[-1] in ".,;:!?" for w in words) / n, math.log1p(n / max(len(lines), 1)), (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum("A" <= w[0] <= "Z" for w in words) / n, text.count("!") / n, text.count("|") / n, max(Counter(words).values()) / n,
    ]


def test_scores_by_plain_loops(spark):
    """Statistics, ridge, bins and curve of the whole table against loops and a direct solution."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: plain_statistics(r.text) for r in docs.collect()}
    y = {r.doc_id: float(r.quality) for r in labels.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in y}
    fitted = [i for i in sorted(y) if fold[i] in (0, 1)]
    rows, target = np.array([x[i] for i in fitted]), np.array([y[i] for i in fitted])
    mean = rows.mean(0)
    scale = np.sqrt(np.maximum((rows**2).mean(0) - mean**2, 1e-6))
    rng = np.random.default_rng(17)
    d = len(STATISTICS)
    turn, phase = rng.normal(0, 1 / np.sqrt(d), (d, quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    feature = lambda r: np.append(np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((np.array(r) - mean) / scale, -6, 6) @ turn + phase), 1.0)
    z = np.array([feature(r) for r in rows])
    weight = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE * len(z) / quality.FEATURES) * np.eye(z.shape[1])]), np.append(target, np.zeros(z.shape[1])), rcond=None)[0]
    raw = {i: float(np.clip(feature(r) @ weight, -1, 2)) for i, r in x.items()}
    bins = {}
    for i in (i for i in y if fold[i] == 3):
        bins.setdefault(math.floor(raw[i] * quality.BINS / 3 + 0.5) if raw[i] >= 0 else math.ceil(raw[i] * quality.BINS / 3 - 0.5), []).append(i)
    knots, share = pool_adjacent(*(np.array(v) for v in zip(*[(np.mean([raw[i] for i in b]), sum(y[i] for i in b), float(len(b))) for _, b in sorted(bins.items())])))
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    want = {i: float(np.interp(v, knots, share)) for i, v in raw.items()}
    assert got.keys() == want.keys()
    assert np.mean([abs(got[i] - want[i]) < 1e-4 for i in got]) > 0.99  # a raw score at the edge of a bin may fall on either side


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d = len(STATISTICS)
    scorer = Scorer(np.zeros(d), np.ones(d), rng.normal(0, 1 / np.sqrt(d), (d, 20000)), rng.uniform(0, 2 * np.pi, 20000), None, None, None)
    x = rng.normal(size=(6, d))
    z = scorer.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - want).max() < 0.03


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())
    known = [(r.quality, found[r.doc_id]) for r in labels.collect() if found[r.doc_id].held_out]
    assert np.mean([q == f.predicted for q, f in known]) > 0.95
    good, bad = ([f.score for q, f in known if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_edge_cases(spark):
    rows = [(i, "fine words in a line." if i % 2 else "### | ###") for i in range(60)] + [(None, "text"), (70, None), (71, ""), (71, ""), (72, "long " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (70, None), (5, 1)], "doc_id long, quality int")
    clash = docs.selectExpr("doc_id", "text", "1 as TEXT", "2 as quality", "0.5 as score")
    found = score_quality(clash, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {r.predicted for r in found if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2} == {1}
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert score_quality(docs.limit(0), labels).count() == 0
