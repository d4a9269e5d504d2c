import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens.llm import byte_bpe as bb
from basketlens.llm.queries import op11_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bb.Encoder(PATH, PATTERN, bb.newer_letters(bb._properties(PATTERN)))


def ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def naive(piece, ranks):
    """Merge the leftmost pair of the smallest rank, found by looking at all pairs."""
    tokens = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if a + b in ranks]
        if not found:
            return [ranks[t] for t in tokens]
        i = min(found)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_tree_equals_scan_of_all_pairs(encoder, piece):
    assert bb.MergeTree(piece, encoder.ranks, encoder.longest).merge() == naive(piece, encoder.ranks)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=64) | st.text("abcdeft", min_size=1, max_size=40).map(str.encode), min_size=1, max_size=40))
def test_forest_equals_trees(encoder, pieces):
    got = [np.frombuffer(x, "<u4").tolist() for x in bb.merge_forest(pieces, encoder.pairs)]
    assert got == [naive(p, encoder.ranks) for p in pieces]


def test_ties_are_taken_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301}
    for n in range(1, 40):
        assert bb.MergeTree(b"a" * n, ranks, 3).merge() == naive(b"a" * n, ranks)
        assert np.frombuffer(bb.merge_forest([b"a" * n], bb.Pairs(ranks))[0], "<u4").tolist() == naive(b"a" * n, ranks)
    rng = random.Random(3)
    ranks |= {b"ab": 302, b"ba": 303, b"aba": 304, b"abab": 305, b"bb": 306}
    for _ in range(300):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30)))
        assert bb.MergeTree(piece, ranks, 4).merge() == naive(piece, ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_equals_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(encoder, text) == library.encode_ordinary(text)


def test_characters_newer_than_the_library(encoder, library):
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for a in range(0, len(every), 4000):
        text = "x1".join(every[a : a + 4000])
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_long_matches_and_texts(encoder, library):
    rng = random.Random(5)
    for text in ("a" * 30_000, "".join(rng.choices("abcdefgh", k=30_000)), " " * 5000 + "x", "!?" * 9000, "word " * 20_000, "12 345\r\n\t" * 5000, "東京" * 3000):
        assert ids(encoder, text) == library.encode_ordinary(text)


def test_kept_matches_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bb, "MOST_KEPT", 50)
    monkeypatch.setattr(bb, "MATCHES_AT_ONCE", 20)
    own = bb.Encoder(PATH, PATTERN, bb.newer_letters(bb._properties(PATTERN)))
    text = " ".join(f"w{i}" for i in range(500)) + "z" * 100
    assert ids(own, text) == library.encode_ordinary(text)
    assert len(own.kept) <= 50
    for a in range(0, 400, 30):
        text = " ".join(f"w{i}" for i in range(a, a + 40)) + "z" * 100
        assert ids(own, text) == library.encode_ordinary(text)
        assert 0 < len(own.kept) <= 50 and all(len(k) <= bb.LONGEST_KEPT for k in own.kept)


def test_matches_of_many_texts_at_once(encoder, library, monkeypatch):
    monkeypatch.setattr(bb, "MATCHES_AT_ONCE", 7)
    texts = ["", "a b c d e f g h i j", "x", "", "it's 12 o'clock, " * 9, " ", "\U0001cd00 a\u0558b" * 5]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert encoder.encode([]) == []


def test_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "it's\u00a0 12\n\n x <|endoftext|>"), (3, "it's\u00a0 12\n\n x <|endoftext|>"), (4, "\x00\x1c é 👩‍👩‍👧")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for frame in (df, df.selectExpr("text", "1 as ids", "2 as TEXT", "doc_id", "'x' as decoded")):
        encoded = bb.encode(frame, PATH, PATTERN)
        assert encoded.columns == ["doc_id", "n_tokens", "ids"]
        got = bb.decode(encoded, PATH).withColumn("array", bb.ids_array("ids")).collect()
        want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
        assert sorted(((r.doc_id, r.array, bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)
        assert all(r.n_tokens == len(r.array) for r in got)
    assert bb.decode(bb.encode(df.limit(0), PATH, PATTERN), PATH).collect() == []


def test_ids_that_are_not_of_the_vocabulary(spark):
    rows = [(1, bytearray(b"\x01\x00")), (2, bytearray(b"\xff\xff\xff\xff")), (3, None), (4, bytearray()), (5, bytearray(b"\x00\x00\x00\x00"))]
    got = {r.doc_id: r.decoded for r in bb.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH).collect()}
    assert got == {1: None, 2: None, 3: None, 4: b"", 5: b"!"}


def test_query_on_the_whole_table(spark, library):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        own = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = op11_byte_bpe(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
