"""How the sources of each language differ in their words: chi-square divergences of term shares.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are
lower-cased.  Each Arrow batch is counted by compute functions alone
(ascii_lower, split_pattern_regex, dictionary_encode, hash group_by) inside
mapInArrow; a task adds its batches up to ``HELD_ROWS`` counts before it
sends them.  The partial counts are merged by (lang, source, term), terms in
fewer than ``MIN_DOCUMENTS`` rows of their language go, and the rest is cut
into columnar shards: a language has one for each ``SHARD_ROWS`` of its
counts, by a hash of the term.  A shard fills its matrix of terms by sources
block by block and gives its part of every sum over terms, and its best
``top`` terms of each source; the parts are added and ranked.

All arithmetic is exact, in integers.  With N the occurrences of kept terms
in a group and V the kept terms of its language, a term's share is
p = 1 + floor(10^9 (count + 1) / (N + V)), and that of p against q is
floor((p - q)^2 / q).  The divisions are carried out in steps of three
digits, so counts up to 9 * 10^15 do not overflow.

Nulls: a null text, lang or source is ''.  Repeated rows are documents of
their own (ids are not read).  Empty texts make a group with no occurrence.
Ties of value are ranked by item, in order of its UTF-8 bytes.  A language
without kept terms has pairs of value 0 and no terms.  An empty table gives
no rows.  Extra columns and names that differ in case only are left out.

A language's pairs are its sources squared, in the result and in each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.runtime import checkpoint, lean_cogroup, lean_map, pick, ship
from basketlens.llm.words import slices

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE_STEPS, STEP = 3, 1000  # shares are whole 10^-9 parts: three steps of three digits
HELD_ROWS = 200_000
SHARD_ROWS = 100_000
BLOCK_CELLS = 1 << 20
_BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_COUNTS = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, source string, part string, item string, value long"


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch of (lang, source, text): occurrences, and rows with the term."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=_BREAK)
    term, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.greater(pc.binary_length(term), 0)
    term, row = term.filter(filled).dictionary_encode(), row.filter(filled)
    per_row = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    group = pa.table({"l": lang.indices.take(per_row["row"]), "s": source.indices.take(per_row["row"]), "term": per_row["term"], "n": per_row["count_all"]})
    total = group.group_by(["l", "s", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({
        "lang": lang.dictionary.take(total["l"]), "source": source.dictionary.take(total["s"]), "term": term.dictionary.take(total["term"]),
        "n": total["n_sum"], "docs": total["n_count"],
    })


def _merged(tables: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return total.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            held.append(term_counts(part))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [_merged(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _merged(held).to_batches(max_chunksize=1 << 16)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exactly."""
    whole, rest = np.divmod(count + 1, total)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * STEP, total)
        whole = whole * STEP + more
    return 1 + whole


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) ** 2 // q


def _best(found: pa.Table, top: int) -> pa.Table:
    """The first ``top`` rows of each source by value, then term."""
    ranked = found.sort_by([("source", "ascending"), ("value", "descending"), ("term", "ascending")])
    source = ranked["source"].to_numpy()
    begin = np.flatnonzero(np.diff(source, prepend=-1))
    place = np.arange(len(source)) - np.repeat(begin, np.diff(np.append(begin, len(source))))
    return ranked.filter(pa.array(place < top))


def _diverge(top: int):
    def one(counts: pa.Table, groups: pa.Table) -> pa.Table:
        """``counts``: (source, term, n) of one shard; ``groups``: (lang, source, n_all, kept) of all sources of its language."""
        lang, name = groups["lang"][0].as_py(), groups["source"].combine_chunks()
        n_all, kept = groups["n_all"].to_numpy(), int(groups["kept"][0].as_py())
        m = len(name)
        pair = np.zeros((m, m), dtype=np.int64)
        found = []
        if counts.num_rows:
            term = counts["term"].combine_chunks().dictionary_encode()
            code, source, n = term.indices.to_numpy(), pc.index_in(counts["source"], name).to_numpy(), counts["n"].to_numpy()
            order = np.argsort(code, kind="stable")
            code, source, n = code[order], source[order], n[order]
            step = max(1, BLOCK_CELLS // m)
            for a in range(0, len(term.dictionary), step):
                b = min(a + step, len(term.dictionary))
                i, j = np.searchsorted(code, [a, b])
                block = np.zeros((b - a, m), dtype=np.int64)
                block[code[i:j] - a, source[i:j]] = n[i:j]
                p = shares(block, n_all + kept)
                for k in range(m):
                    pair[:, k] += excess(p, p[:, k : k + 1]).sum(axis=0)
                q = shares(block.sum(axis=1), np.int64(n_all.sum() + kept))[code[i:j] - a]
                own = p[code[i:j] - a, source[i:j]]
                more = own > q
                found.append(pa.table({
                    "source": pa.array(source[i:j][more].astype(np.int32)), "term": term.dictionary.take(pa.array(code[i:j][more])),
                    "value": pa.array(excess(own[more], q[more])),
                }))
                found = [_best(pa.concat_tables(found), top)]
        x, y = np.nonzero(~np.eye(m, dtype=bool))
        parts = [pa.table({"source": name.take(pa.array(x)), "part": pa.array(["pair"] * len(x), pa.string()), "item": name.take(pa.array(y)), "value": pa.array(pair[x, y])})]
        for t in found:
            parts.append(pa.table({"source": name.take(t["source"].combine_chunks()), "part": pa.array(["term"] * len(t), pa.string()), "item": t["term"], "value": t["value"]}))
        out = pa.concat_tables(parts)
        return out.add_column(0, "lang", pa.array([lang] * out.num_rows, pa.string()))

    return one


def kept_counts(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, leads) of the terms in enough rows of their language; ``leads`` on one row of each (lang, term)."""
    ship(documents.sparkSession)
    text = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = text.mapInArrow(lean_map(_count), _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("all_docs", F.sum("docs").over(of_term)).withColumn("leads", F.row_number().over(of_term.orderBy("source")) == 1)
    return counts.where(F.col("all_docs") >= min_documents).select("lang", "source", "term", "n", "leads")


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source, its divergence from every other one and its most typical terms."""
    docs = pick(documents, "lang", "source", "text")
    kept = checkpoint(kept_counts(docs, min_documents))
    of_lang = Window.partitionBy("lang")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.sum(F.col("leads").cast("long")).alias("leads"))
    groups = groups.join(sums, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce(F.sum("leads").over(of_lang), F.lit(0)).alias("kept")
    )
    # Languages of several shards: at most one for each SHARD_ROWS rows of the counts.
    large = kept.groupBy("lang").count().where(F.col("count") > SHARD_ROWS).select("lang", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("shards"))
    shards = F.coalesce("shards", F.lit(1))
    left = kept.join(F.broadcast(large), "lang", "left").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"))
    right = groups.join(F.broadcast(large), "lang", "left").select("lang", "source", "n_all", "kept", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    parts = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(lean_cogroup(_diverge(top)), _FOUND)
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    of_group = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return whole.withColumn("rank", F.row_number().over(of_group)).where((F.col("part") == "pair") | (F.col("rank") <= top))


def audit_sql(min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> str:
    """The same in DuckDB SQL, over every (term, source) of a language."""
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), words AS (
    SELECT row_no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row_no) >= {min_documents}
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), every AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, s.v
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
    SELECT lang, source, term, n,
           1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
           1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
    FROM every
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= {top}
"""
