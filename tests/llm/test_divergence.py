import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from basketlens.llm import divergence as dv
from basketlens.llm.queries import op12_source_divergence_audit

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_force(rows, top=200):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t) for t in TERM.findall(text)] for _, _, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(r[1], t) for r, t in zip(rows, terms) if r[0] == lang]
        seen = Counter(x for _, t in own for x in set(t))
        kept = sorted(x for x in seen if seen[x] >= 3)
        count = defaultdict(Counter)
        for source, t in own:
            count[source].update(x for x in t if seen[x] >= 3)
            count[None].update(x for x in t if seen[x] >= 3)
        share = {s: {x: 1 + 10**9 * (count[s][x] + 1) // (sum(count[s].values()) + len(kept)) for x in kept} for s in count}
        sources = {s for s, _ in own}
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            for part, found in (
                ("pair", [(sum(f(share[s][x], share[o][x]) for x in kept), o) for o in sources - {s}]),
                ("term", [(f(share[s][x], share[None][x]), x) for x in kept if count[s][x] and share[s][x] > share[None][x]]),
            ):
                found.sort(key=lambda v: (-v[0], v[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in dv.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    ("en", "a", "The the THE Cat's cat_x 9cat é É"), ("en", "a", "the cat\x00dog the"), ("en", "b", "the dog dog; dog é"), ("en", "b", "dog É ÉTÉ été cat"),
    ("en", "c", None), ("en", None, "the cat dog É dog"), (None, "a", "x y"), (None, None, ""), ("de", "a", "die"), ("de", "a", "die"), ("de", "a", "die"), ("fr", "z", "42 @[`{\x7f"),
    ("en", "東", "dog 東 東京 \U0001f600 the"), ("en", "東", "東 the \U0001f600"), ("en", "é", "東 \U0001f600￮ the￮ ￮"), ("en", "é", "￮ \U0001f600 ￮"),
]


def test_brute_force(spark):
    df = spark.createDataFrame(ROWS, "lang string, source string, text string")
    want = brute_force(ROWS)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] > 0 for r in want)
    assert found(df) == want
    assert found(df.selectExpr("text", "1 as TEXT", "source", "lang", "2 as term", "3 as n").repartition(7)) == want
    assert found(df.limit(0)) == []
    assert found(df, top=1) == [r for r in want if r[2] == "pair" or r[5] == 1]
    doubled = brute_force(ROWS * 3)
    assert doubled != want and found(df.union(df).union(df)) == doubled


def test_no_kept_terms(spark):
    rows = [("en", s, "one two") for s in "ab"]
    assert found(spark.createDataFrame(rows, "lang string, source string, text string")) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_several_shards_blocks_and_held_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(rng.choice(["en", "de"]), f"s{min(rng.geometric(0.3), 6)}", " ".join(f"w{'x' * int(k)}" for k in rng.geometric(0.05, 60))) for _ in range(200)]
    rows = [tuple(map(str, r)) for r in rows]
    want = brute_force(rows)
    monkeypatch.setattr(dv, "SHARD_ROWS", 50)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(df) == want
    batch = df.toArrow().select(["lang", "source", "text"])
    whole = dv._merged([dv.term_counts(b) for b in batch.to_batches()]).sort_by([(c, "ascending") for c in ("lang", "source", "term")])
    monkeypatch.setattr(dv, "HELD_ROWS", 100)
    parts = list(dv._count(iter(batch.to_batches(max_chunksize=9))))
    assert len(parts) > 1
    import pyarrow as pa

    assert dv._merged([pa.Table.from_batches(parts)]).sort_by([(c, "ascending") for c in ("lang", "source", "term")]).equals(whole)
    groups = sorted({r[1] for r in rows if r[0] == "en"})
    monkeypatch.setattr(dv, "BLOCK_CELLS", 20)
    counts = whole.filter(pa.compute.equal(whole["lang"], "en"))
    n_all = [sum(n for s, n in zip(counts["source"].to_pylist(), counts["n"].to_pylist()) if s == g) for g in groups]
    kept = len(set(counts["term"].to_pylist()))
    table = pa.table({"lang": ["en"] * len(groups), "source": groups, "n_all": pa.array(n_all, pa.int64()), "kept": pa.array([kept] * len(groups), pa.int64())})
    small = dv._diverge(5)(counts, table)
    monkeypatch.setattr(dv, "BLOCK_CELLS", 1 << 20)
    assert small.equals(dv._diverge(5)(counts, table))


def test_long_text(spark):
    rows = [("en", "a", "word " * 300_000), ("en", "a", "x" * 1_000_000 + " word"), ("en", "b", "word x")]
    assert found(spark.createDataFrame(rows, "lang string, source string, text string")) == brute_force(rows)


@pytest.mark.parametrize("count,total", [(0, 1), (0, 10), (7, 10**15), (10**15 - 2, 10**15), (8 * 10**15, 9 * 10**15), (12_345_678_901_234, 10**15 + 7)])
def test_shares_are_exact(count, total):
    assert dv.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = op12_source_divergence_audit(spark, SF)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(con.execute(dv.audit_sql()).fetchall())
    assert got == brute_force([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "source", "text").collect()])
