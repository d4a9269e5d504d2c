import random
import re
from itertools import combinations

import numpy as np

from basketlens.llm import jaccard_join
from basketlens.llm.graph import components, local_components
from basketlens.llm.jaccard_join import enough_matches, overlaps, similar_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = WORD.findall(text or "")
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def brute_force(rows, threshold=0.8):
    """[(doc_id, same_id, class_id, n_links, n_linked_texts)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    ids = [d for d, _ in rows]
    same, links, texts = {}, [0] * len(rows), [set() for _ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        same.setdefault(s, []).append(i)
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            if a != b:
                texts[i].add(b)
                texts[j].add(a)
            parent[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    out = []
    for i, s in enumerate(sets):
        own = min(ids[j] for j in same[s]) if s else ids[i]
        out.append((ids[i], own, least[find(i)] if s else ids[i], links[i], len(texts[i])))
    return sorted(out)


def found(df, **k):
    return sorted(tuple(r) for r in similar_documents(df, **k).drop("row_key", "class_key").collect())


def test_pruning_table_keeps_pairs_at_the_threshold():
    table = enough_matches(0.8, 160, 16, 1e-6)
    rng = np.random.default_rng(5)
    equal = rng.random((20000, 160)) < 0.8
    kept = np.all([equal[:, :k].sum(1) >= m for k, m in table], axis=0)
    assert kept.mean() > 0.9999
    far = rng.random((2000, 160)) < 0.5
    assert np.all([far[:, :k].sum(1) >= m for k, m in table], axis=0).mean() < 0.01


def test_overlaps_in_blocks():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(50), rng.randint(1, 30))), dtype=np.uint64) for _ in range(12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    assert overlaps(sets, most=36).tolist() == want == overlaps(sets).tolist()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [(a, b) for a, b in edges if a is not None and a != b]
    label = local_components(np.array([a for a, _ in real]), np.array([b for _, b in real]), 141)
    assert got == {x: int(label[x]) for e in real for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)  # groups in several blocks
    base = [f"w{i}" for i in range(60)]
    rows = [(i + 20, " ".join(base[:k] + ["x" + str(i)] + base[k:])) for i, k in enumerate([1, 20, 40, 59])]
    rows += [(1, "  " + "\n".join(base)), (9, " ".join(base)), (9, " ".join(base)), (3, None), (4, ""), (5, "a b"), (6, "a  b"), (7, "b a"), (8, "the " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute_force(rows)
    assert found(df.selectExpr("doc_id", "text", "7 as key", "2 as Text")) == brute_force(rows)
    assert found(df.limit(0)) == []
    unnamed = similar_documents(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "q")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_links) for r in unnamed) == [(False, 0), (True, 1), (True, 1)]


def test_repeated_ids(spark):
    """Texts of one id are documents of their own: each keeps its links and its copy in the result."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (4, "apart"), (4, "from it"), (4, "apart"), (None, f"{b} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_links): r.class_id for r in similar_documents(df).collect()}
    assert len(got) == 7 and got[1, 1] == got[2, 1] == 1 and got[4, 1] == got[4, 0] == 4
    assert got[1, 2] == got[3, 2] == got[None, 2] < 0  # a null id counts as a negative number
    known = rows[:7]
    assert found(spark.createDataFrame(known, "doc_id long, text string")) == brute_force(known)
    kept = sorted(tuple(r) for r in jaccard_join.one_of_each(df.where("doc_id is not null")).collect())
    assert kept == sorted([(1, a), (1, b), (4, "apart"), (4, "from it")])


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert found(df) == brute_force(rows)
    assert found(df, threshold=0.6) == brute_force(rows, 0.6)
