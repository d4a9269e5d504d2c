import re

import pytest

from basketlens.llm import decontaminate
from basketlens.llm.decontaminate import contained_items

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(text or "")
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def brute_force(docs, items, threshold=0.8, n=5):
    """By the definition: shorter items stand in a row, others share enough of their shingles."""
    out = []
    sets = [(i, WORD.findall(t or ""), shingles(t)) for i, t in items]
    for d, t in docs:
        words, own = WORD.findall(t or ""), shingles(t)
        for i, w, s in sets:
            if 0 < len(w) < n:
                if any(words[k : k + len(w)] == w for k in range(len(words) - len(w) + 1)):
                    out.append((d, i, 1, 1))
            elif s and len(s & own) >= threshold * len(s) - 1e-9:
                out.append((d, i, len(s & own), len(s)))
    return sorted(out, key=str)


def found(docs, items, **k):
    return sorted((tuple(r) for r in contained_items(docs, items, **k).collect()), key=str)


def test_edge_cases(spark, monkeypatch):
    item = [f"i{k}" for k in range(54)]  # 50 shingles
    long = " ".join(f"w{k}" for k in range(50000))
    broken = item.copy()
    broken[12], broken[40] = "x", "y"  # 10 of 50 shingles go
    worse = broken.copy()
    worse[26] = "z"
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "a b"), (5, "p q r s t u"), (5, "p q r s t u"), (None, "p q r s t")]
    docs = [
        (1, long + " " + " ".join(item) + " " + long), (2, " ".join(broken)), (3, "\n".join(worse)), (4, None), (5, ""),
        (6, "a  b"), (7, "z a b c d e"), (8, "x p q r s t u v"), (8, "x p q r s t u v"), (None, "p q r s t"), (9, "p q r s"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute_force(docs, items)
    assert (2, 1, 40, 50) in want and not any(r[0] == 3 for r in want)
    assert found(d, b) == want
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 20)  # several blocks of items
    assert found(d.selectExpr("doc_id", "text", "1 as Text", "2 as item_id"), b.selectExpr("text", "item_id", "3 as doc_id")) == want
    assert found(d, b.limit(0)) == [] == found(d.limit(0), b)


def test_short_items(spark, monkeypatch):
    docs = [
        (1, "one two three alpha beta gamma delta four five six seven eight nine ten"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma"), (4, "gamma delta alpha beta"),
        (5, "x alpha"), (6, "beta"), (7, "q alpha beta gamma delta"), (8, None), (9, "alpha beta gamma x delta " * 300 + "beta alpha"),
    ]
    items = [(1, "alpha beta gamma delta"), (2, "beta  gamma"), (3, "beta"), (4, "beta alpha"), (5, "alpha beta gamma delta four"), (6, "beta gamma"), (None, "x\nalpha")]
    want = brute_force(docs, items)
    assert (1, 1, 1, 1) in want and (1, 5, 1, 1) in want and (4, 1, 1, 1) not in want and (9, 4, 1, 1) in want
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(d, b) == want
    kept = {r.doc_id for r in decontaminate.without_items(d, b).collect()}
    assert kept == {i for i, _ in docs} - {r[0] for r in want}
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 2)
    assert found(d, b) == want


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_against_brute_force(spark, threshold):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    want = brute_force([tuple(r) for r in d.collect()], [tuple(r) for r in b.collect()], threshold)
    assert want and found(d, b, threshold=threshold) == want
