import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from basketlens.llm import substring_dedup as sd
from basketlens.llm.substring_dedup import dedup_substrings, pack_sorted, unpack_sorted, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute_force(rows, window=20):
    """{(doc_id, text): (n_words, n_removed, sha)} by a dictionary of word tuples."""
    last = 2**63 - 1
    words = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, w), (doc_id, _) in zip(words, rows, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, window=20):
    return sorted((tuple(r) for r in dedup_substrings(df, window).collect()), key=str)


@given(st.lists(st.integers(0, 2**62), max_size=200))
def test_sorted_integers_round_trip(values):
    values = np.unique(np.array(values, dtype=np.uint64))
    assert np.array_equal(unpack_sorted(pack_sorted(values)), values)


def test_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [
        (5, line), (2, "x " + line + "\n y"), (2, "x " + line + "\n y"), (None, line), (7, None), (8, ""),
        (9, "a\tb　c\x0bd"), (10, "the " * 3000), (11, "z " * 19), (12, line + " " + line),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute_force(rows)
    clash = df.selectExpr("doc_id", "text", "1 as TEXT", "'q' as key", "2 as chunk")
    assert found(clash) == brute_force(rows)
    assert found(df.limit(0)) == []
    cut = without_repeats(clash).collect()
    assert clash.columns == without_repeats(clash).columns
    assert sorted(WORD.sub("w", r[1] or "").count("w") for r in cut) == sorted(r[1] - r[2] for r in brute_force(rows))
    assert {r[1] for r in cut if r[0] == 9} == {rows[6][1]}  # a text that loses nothing keeps its white space


def test_a_hot_passage_sends_one_start_a_chunk():
    """A passage in every document: what a chunk sends of it does not grow with its documents."""
    passage = " ".join(f"p{i}" for i in range(40))
    sizes = []
    for n in (20, 200):
        texts = [f"own{i} {passage} tail{i} {passage}" for i in range(n)]
        table = pa.table({"chunk": pa.array([3] * n, pa.int32()), "doc_id": pa.array(range(n), pa.int64()), "text": texts})
        told = sd._sketch(20, 1, 1 << 40)(table)
        found = sd._candidates(20, 1, 1 << 40)(table, sd._merge(told))
        sizes.append(sum(map(len, found["first"].to_pylist())) // sd._FIRST.itemsize)
        assert sd._exact(found).num_rows == 0  # no other chunk has it
    assert sizes == [21, 21]
    other = pa.table({**{c: found[c] for c in ("rng", "first")}, "chunk": pa.array([9], pa.int32())})
    late = sd._exact(pa.concat_tables([found.select(["chunk", "rng", "first"]), other.select(["chunk", "rng", "first"])]))
    assert late.num_rows == 0  # the same starts: neither is earlier


@pytest.mark.parametrize("window", [20, 5])
def test_against_brute_force(spark, window):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert found(df, window) == brute_force([tuple(r) for r in df.collect()], window)
