"""Quality rules with tokeniser fertility.

Base rules: too few words, or too many words inside 5-word windows that the
text has twice.  The method's rule: each word is encoded by a public
vocabulary with byte fallback, and a text is rejected when one of

* characters per token,
* share of tokens that are single bytes (byte fallback),
* entropy of its tokens in bits

lies outside the band of its kind.  A kind is a language and script and a size
class (tokens, by powers of 2: entropy grows with the text).  The script is
that of most letters; the language is the column ``lang``, if there is one,
where it holds at least a ``COMMON`` part of the documents.  The band of a kind
are the quartiles of its core, less and plus ``REACH`` quartile distances (and
a ``SLACK``, for measures that are all equal).  For normally distributed
measures these lie at 4.25 standard deviations, so one clean document in 10,000
is rejected by each; heavier tails of clean text may have ``FALSE_REJECTED``.
Where no language is known, a kind mixes the languages of its script, which
have different fertility; its band then has ``MIXED_REACH`` and ``MIXED_SLACK``.
It is made from all documents that pass the base rules.  So that bad documents
don't widen it,

* a source (a column ``source``, if there is one, in ``SOURCES`` groups) counts
  in a kind as many documents as the middle one of its sources, at most;
* the core is what lies within ``CORE`` half lengths (and the slack) of the
  middle of the shortest interval with half of the kind.  A third of a kind, so
  counted, may be bad and far out without being in it.

A kind with fewer than ``LEAST_KIND`` documents, so counted, is held against
the nearest size classes of its language and script together, until they have
as many; a language that has fewer in all against its script, a script that has
fewer, and texts without a letter, against all.  Documents of other size
classes are moved by the trend of the measure over the pooled classes (a line
through their medians); as a trend may end there, the band holds that of the
unmoved documents too.  Distributions are ``GRID`` quantiles by kind and group of sources,
Spark's, to a rank error of 1/1000.

Nulls: a null text has no words (base_failed); a null doc_id stays.  Repeated
rows are judged each.  An empty table gives no rows.  Ties: a measure at the
edge of its band is inside; a text with equally many letters of two scripts has
the first in name order.  Extra columns and columns whose names differ in case
only are left out.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.quality import line_keys, repeats
from basketlens.llm.runtime import checkpoint, lean_map, pick, ship
from basketlens.llm.tokens import spread, word_tokens
from basketlens.llm.words import U, Words, grams, mix, slices, words_of

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
WINDOW = 5
REACH = 2.65
CORE = 4.0
LEAST_KIND = 40
COMMON = 1000  # a language has at least one in so many documents
FALSE_REJECTED = 0.02  # of clean documents, at most
SOURCES = 8
GRID = 41
SLACK = {"chars_per_token": 0.02, "byte_share": 0.02, "entropy": 0.05}
MIXED_REACH = 4.0
MIXED_SLACK = {"chars_per_token": 0.5, "byte_share": 0.05, "entropy": 1.0}

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_MEASURED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string, sources int, lang string"

_SCRIPTS: dict[int, int] = {}
_NAMES: list[str] = ["none"]


def script_numbers(codes: np.ndarray) -> np.ndarray:
    """Number (in _NAMES) of the script of each code point; 0 for what is no letter."""
    unique, inverse = np.unique(codes, return_inverse=True)
    for c in unique.tolist():
        if c not in _SCRIPTS:
            # names of letters begin with their script: LATIN SMALL LETTER A
            name = unicodedata.name(chr(c), "").split(" ")[0].split("-")[0].lower() if unicodedata.category(chr(c))[0] == "L" else "none"
            if name not in _NAMES:
                _NAMES.append(name)
            _SCRIPTS[c] = _NAMES.index(name)
    return np.array([_SCRIPTS[c] for c in unique.tolist()], dtype=np.int64)[inverse]


def scripts(texts: pa.Array) -> list[str]:
    """Script of most letters of each text (the first in name order if equal)."""
    out = []
    for text in texts.to_pylist():
        raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        ascii_letters = int((((raw | 32) >= 97) & ((raw | 32) <= 122)).sum())
        number = np.bincount(script_numbers(raw[raw > 127]), minlength=len(_NAMES))
        counts = {name: int(k) for name, k in zip(_NAMES, number, strict=False) if k and name != "none"}
        counts["latin"] = counts.get("latin", 0) + ascii_letters
        best = max(counts.values())
        out.append(min(k for k, v in counts.items() if v == best) if best else "none")
    return out


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that it has twice or more."""
    hashes, at, first = grams(words, window, short_as_one=False)
    text = np.repeat(np.arange(len(words.counts)), np.diff(first))
    _, inverse, number = np.unique(mix(hashes ^ mix(text.astype(U), 0x21)), return_inverse=True, return_counts=True)
    twice = number[inverse] > 1
    start = words.first[text[twice]] + at[twice]
    step = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
    return covered[words.first[1:]] - covered[words.first[:-1]]


def token_entropy(ids: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Entropy in bits of the tokens of each text."""
    both = np.sort(text.astype(np.int64) << 32 | ids.astype(np.int64))
    new = np.flatnonzero(np.diff(both, prepend=-1))
    number = np.diff(np.append(new, len(both))).astype(np.float64)
    owner = (both[new] >> 32).astype(np.int64)
    total = np.bincount(text, minlength=texts)
    return -np.bincount(owner, number / total[owner] * np.log2(number / total[owner]), minlength=texts) + 0.0


def _measure(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_tokens("sentencepiece", model)
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        single = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, n = words_of(part["text"]), part.num_rows
                begun = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
                size = np.concatenate([[0], np.cumsum(begun[words.ends] - begun[words.starts])])
                chars = size[words.first[1:]] - size[words.first[:-1]]
                symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[words.data])])[np.concatenate([[0], words.text_end])]
                start, count = cache.of(words)
                ids = cache.pool[spread(start, count)]
                text = np.repeat(np.repeat(np.arange(n), words.counts), count)
                tokens = np.bincount(text, minlength=n)
                some = np.maximum(tokens, 1)
                line_text, line_key = line_keys(words)
                yield pa.RecordBatch.from_arrays([
                    part["doc_id"], pa.array(words.counts, pa.int64()), pa.array(chars, pa.int64()), pa.array(np.diff(symbols), pa.int64()),
                    pa.array(repeats(line_text, line_key, n), pa.int64()), pa.array(repeated_words(words), pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array(chars / some), pa.array(np.bincount(text, single[ids], minlength=n) / some), pa.array(token_entropy(ids, text, n)), pa.array(scripts(part["text"]), pa.string()), part["sources"], part["lang"],
                ], names=[f.split()[0] for f in _MEASURED.split(", ")])

    return run


def band(values: np.ndarray, weights: np.ndarray, slack: float, reach: float) -> tuple[float, float]:
    """Quartiles of the core of weighted values, less and plus ``reach`` quartile distances and the slack."""
    order = np.argsort(values, kind="stable")
    x, upto = values[order], np.cumsum(weights[order])
    half = np.searchsorted(upto, upto - weights[order] + upto[-1] / 2 - 1e-9 * upto[-1])
    at = np.flatnonzero(half < len(x))
    k = at[np.argmin(x[half[at]] - x[at])]
    middle, length = (x[half[k]] + x[k]) / 2, (x[half[k]] - x[k]) / 2
    core = np.abs(x - middle) <= CORE * length + slack
    x, upto = x[core], np.cumsum(weights[order][core])
    low, high = x[np.searchsorted(upto, [0.25 * upto[-1], 0.75 * upto[-1]])]
    more = reach * (high - low) + slack
    return float(low - more), float(high + more)


def _pooled_band(cells: pd.DataFrame, measure: str, size: int, slack: float, reach: float) -> tuple[float, float]:
    """Band of the cells for a size class: of their values, and of these moved to the class by their trend."""
    values, weights = np.stack(cells[measure].to_list()), cells["weight"].to_numpy(float)
    classes = cells["size_class"].to_numpy(float)
    if len(set(classes)) > 1:
        middle = values[:, GRID // 2]
        x, y = classes - np.average(classes, weights=weights), middle - np.average(middle, weights=weights)
        moved = values + (np.sum(weights * x * y) / np.sum(weights * x * x) * (size - classes))[:, None]
        both = [band(v.ravel(), np.repeat(weights / GRID, GRID), slack, reach) for v in (values, moved)]
        return min(low for low, _ in both), max(high for _, high in both)
    return band(values.ravel(), np.repeat(weights / GRID, GRID), slack, reach)


def bands(cells: pd.DataFrame) -> list[tuple]:
    """(lang, script, size class, edges of each measure) from (lang, script, size_class, sources, n, GRID quantiles of each measure)."""
    cells = cells.copy()
    most = cells.groupby(["lang", "script", "size_class"])["n"].transform(lambda n: max(np.sort(n)[len(n) // 2], LEAST_KIND // 2))
    cells["weight"] = np.minimum(cells["n"], most)
    lettered = cells[cells["script"] != "none"]
    everything = lettered if len(lettered) else cells
    out = []
    for (lang, script), kind in cells.groupby(["lang", "script"], sort=True):
        wider = (kind, cells[cells["script"] == script], everything)
        own = next((w for w in wider[script == "none" and 2 :] if w["weight"].sum() >= LEAST_KIND), everything)
        slacks, reach = (SLACK, REACH) if lang and own is kind else (MIXED_SLACK, MIXED_REACH)
        for size in sorted(set(kind["size_class"])):
            far = (own["size_class"] - size).abs()
            near = next((d for d in sorted(set(far)) if own.loc[far <= d, "weight"].sum() >= LEAST_KIND), far.max())
            edges = [e for m, slack in slacks.items() for e in _pooled_band(own[far <= near], m, size, slack, reach)]
            out.append((lang, script, int(size), *edges))
    return out


def judge(documents: DataFrame, model: str) -> DataFrame:
    """Base counts, fertility, script, base_failed and kept of each document.

    ``model``: file of a ``sentencepiece`` model with byte fallback.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = pick(documents, "doc_id", "text", *(c for c in ("source", "lang") if c in documents.columns))
    group = F.pmod(F.xxhash64("source"), F.lit(SOURCES)) if "source" in docs.columns else F.lit(0)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", group.cast("int").alias("sources"), lang.alias("lang"))
    measured = docs.mapInArrow(lean_map(_measure(model)), _MEASURED)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = checkpoint(measured.withColumns({"base_failed": failed, "size_class": F.floor(F.log(2.0, F.greatest("n_tokens", F.lit(1)))).cast("int")}))
    # at most COMMON languages
    share = measured.groupBy("lang").count()
    share = share.withColumn("all", share.agg(F.sum("count")).scalar())
    common = share.where((F.col("lang") != "") & (F.col("count") * COMMON >= F.col("all"))).select("lang", F.col("lang").alias("common"))
    measured = measured.join(F.broadcast(common), "lang", "left").withColumn("lang", F.coalesce("common", F.lit(""))).drop("common")
    grid = [(i + 0.5) / GRID for i in range(GRID)]
    quantiles = [F.percentile_approx(m, grid, 1000).alias(m) for m in SLACK]
    # one row for each language, script, size class and group of sources: a few thousand, whatever the number of documents
    cells = measured.where(~F.col("base_failed")).groupBy("lang", "script", "size_class", "sources").agg(F.count("*").alias("n"), *quantiles).toPandas()
    edges = ", ".join(f"{m}_from double, {m}_to double" for m in SLACK)
    edged = spark.createDataFrame(bands(cells) if len(cells) else [], f"lang string, script string, size_class int, {edges}")
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_from"), F.col(f"{m}_to")), F.lit(True))
    joined = measured.join(F.broadcast(edged), ["lang", "script", "size_class"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "script"
    )
