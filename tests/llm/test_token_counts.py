import base64

import public_tokenizers
import pytest
import tiktoken

from basketlens.llm.token_counts import token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def char_owners(encoder, text):
    """Characters of each token (a continued character belongs to the token that begins it)."""
    at, place = 0, {}
    for i, c in enumerate(text):
        for k in range(len(c.encode())):
            place[at] = (i, k)
            at += 1
    at, out = 0, []
    for t in encoder.encode_ordinary(text):
        size = len(encoder.decode_single_token_bytes(t))
        own = [place[b] for b in range(at, at + size)]
        out.append([i for i, k in own if k == 0] or [own[-1][0]])
        at += size
    return out


def brute_force(encoder, rows, rule):
    out = []
    for doc_id, text in rows:
        text = text or ""
        lines, line = [], 0
        for c in text:
            lines.append(line)
            line += c == "\n"
        counts, crossing = [0] * (line + 1), [0] * (line + 1)
        for own in char_owners(encoder, text):
            seen = [lines[i] for i in own]
            best = seen[0] if rule == "start" else min(set(seen), key=lambda s: (-seen.count(s), s))
            counts[best] += 1
            crossing[best] += len(set(seen)) > 1
        parts, start = text.split("\n"), 0
        for k, part in enumerate(parts):
            size = len(part) + (k < len(parts) - 1)
            out.append((doc_id, k, start, size, counts[k], crossing[k]))
            start += size
    return sorted(out, key=str)


def found(df, rule="majority"):
    return sorted((tuple(r) for r in token_counts(df, PATH, PATTERN, rule).collect()), key=str)


@pytest.mark.parametrize("rule", ["majority", "start"])
def test_lines(spark, encoder, rule):
    rows = [(1, None), (2, ""), (None, "a\n\n\n\nb"), (3, "\n"), (4, "x  \n  y\n"), (4, "x  \n  y\n"), (5, "☃☃ 東京\n\r\n 👩‍👩‍👧 <|endoftext|>"), (6, "word " * 3000 + "\n" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(encoder, rows, rule)
    assert any(r[5] for r in want)
    assert found(df, rule) == want
    assert found(df.selectExpr("text", "doc_id", "1 as section", "2 as TEXT"), rule) == want
    assert found(df.limit(0), rule) == []
    with pytest.raises(ValueError):
        token_counts(df, PATH, PATTERN, "none")


def test_given_sections(spark, encoder):
    text = "title here\nbody of it and more"
    df = spark.createDataFrame([(1, text, [(0, 10), (13, 99)]), (2, text, None), (3, None, [(0, 4)])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    rows = found(df)
    total = len(encoder.encode_ordinary(text))
    assert sum(r[4] for r in rows if r[0] == 1) == total == sum(r[4] for r in rows if r[0] == 2)
    assert [r[1:4] for r in rows if r[0] == 1 and r[1] == 0] == [(0, 0, 10)]
    assert [r[1:4] for r in rows if r[0] == 2] == [(None, 0, len(text))]


def test_whole_table(spark, encoder):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("length(text) < 4000")
    rows = [tuple(r) for r in df.collect()]
    assert found(df) == brute_force(encoder, rows, "majority")
