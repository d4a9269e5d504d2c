"""Substring dedup: a count-min prefilter, then exact grouping of the windows it leaves.

A window is ``window`` consecutive words of one document.  A word goes if a
window that covers it also starts earlier (smaller doc_id, or the same
document at an earlier word).  Windows are judged on the input.

1. Documents are dealt to chunks of bounded size.  Each chunk sketches its
   windows: one row of a count-min sketch, whose cells are kept as sorted
   gaps, so the row can be far wider than the corpus has windows.
2. Sketches are merged cell range by cell range.  A merged count never falls
   below the true one, so a window whose cell was seen once is unique.  Each
   chunk gets back the cells that were seen again.
3. Only windows in such cells are grouped, by 96 bits of hash.  A chunk sends
   its first start of each, once however often it has the window, and is told
   those of which another chunk has an earlier start: all of its own go.  Of
   the others, and of windows that only this chunk repeats, all but its first
   start go.

Shuffled: texts once, about two bytes a window for the sketches, then the
distinct windows of a chunk that are estimated repeated.  Cells and windows are
dealt by hash, and a window that is in a third of all documents sends one cell
and one start a chunk, so no group grows with a hot passage.  Chunks and ranges
grow together with the corpus, up to ``MOST_CHUNK`` and ``MOST_RANGE``, so that
a chunk has ``SHARED`` windows for each range as long as these hold.

Nulls: a null text has no words; a null doc_id orders after all others.
Repeated rows (same id and text) are judged alike: neither starts earlier.
Ties: starts at one word of rows with one id are the same start.
Empty and short texts keep all words; an empty table gives no rows.  Extra
columns and columns whose names differ in case only are left out
(``without_repeats`` returns them).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketlens.llm.runtime import lean_cogroup, lean_group, pick, ship
from basketlens.llm.words import U, Words, grams, mix, words_of

WINDOW = 20
CHUNK_BYTES = 4 << 20  # of text a chunk, at least
RANGE_WINDOWS = 1 << 20  # windows a cell range, about, at least
MOST_CHUNK = 48 << 20
MOST_RANGE = 1 << 26
SHARED = 32
WORD_BYTES = 6  # about, to tell windows from bytes
CELLS_PER_WINDOW = 32  # width of the sketch against the windows of the corpus
_LAST = 2**63 - 1

_TOLD = "chunk int, rng int, cells binary"
_FOUND = "chunk int, rng int, first binary"
_GOES = "chunk int, rng int, windows binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as gaps in 7-bit groups, the last group of each marked."""
    gaps = np.diff(values.astype(np.uint64), prepend=U(0))
    if len(gaps) == 0:
        return b""
    width = np.ones(len(gaps), dtype=np.int64)
    for bits in range(7, 64, 7):
        width += gaps >= U(1) << U(bits)
    out = np.zeros(int(width.sum()), dtype=np.uint8)
    end = np.cumsum(width)
    for k in range(int(width.max())):
        has = width > k
        out[(end - width)[has] + k] = ((gaps[has] >> U(7 * k)) & U(127)).astype(np.uint8)
    out[end - 1] |= 128
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) == 0:
        return np.zeros(0, dtype=U)
    last = raw >= 128
    number = np.concatenate([[0], np.cumsum(last)[:-1]])
    start = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - start[number]
    with np.errstate(over="ignore"):
        return np.cumsum(np.add.reduceat((raw & 127).astype(U) << (U(7) * place.astype(U)), start), dtype=U)


def _windows(table: pa.Table, window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(table["text"])
    return words, *grams(words, window, short_as_one=False)


def _cell(hashes: np.ndarray, ranges: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell range and cell in that range of each window (two parts of one hash)."""
    return (mix(hashes, 0x77) % U(ranges)).astype(np.int64), mix(hashes, 0x99) % U(cells)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of each run of equal values (none is negative)."""
    cuts = np.append(np.flatnonzero(np.diff(values, prepend=-1)), len(values))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _by_range(rng: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each range that has entries, with their positions in order."""
    order = np.argsort(rng, kind="stable")
    for a, b in _runs(rng[order]):
        yield int(rng[order[a]]), order[a:b]


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(schema, columns, strict=True)})


_TOLD_ARROW = [("chunk", pa.int32()), ("rng", pa.int32()), ("cells", pa.binary())]
_FOUND_ARROW = [("chunk", pa.int32()), ("rng", pa.int32()), ("first", pa.binary())]
_GOES_ARROW = [("chunk", pa.int32()), ("rng", pa.int32()), ("windows", pa.binary())]
_WINDOW = np.dtype([("hash", "<u8"), ("more", "<u4")])
_FIRST = np.dtype([("hash", "<u8"), ("more", "<u4"), ("id", "<i8"), ("at", "<i4")])


def _sketch(window: int, ranges: int, cells: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, hashes, _, _ = _windows(table, window)
        rng, cell = _cell(hashes, ranges, cells)
        rows = []
        for r, at in _by_range(rng):
            distinct, counts = np.unique(cell[at], return_counts=True)
            # a cell that this chunk alone saw twice is told as seen twice
            value = (distinct << U(1)) | (counts > 1).astype(U)
            rows.append((chunk, r, pack_sorted(value)))
        return _rows(_TOLD_ARROW, rows)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Of one cell range: to each chunk, those of its cells whose merged count is over 1."""
    chunks, told = table["chunk"].to_pylist(), [unpack_sorted(x) for x in table["cells"].to_pylist()]
    r = table["rng"][0].as_py()
    every = np.concatenate(told)
    cells = np.sort(every >> U(1))
    again = np.union1d(cells[1:][cells[1:] == cells[:-1]], every[(every & U(1)) == 1] >> U(1))
    rows = []
    for chunk, values in zip(chunks, told, strict=True):
        own = values >> U(1)
        at = np.searchsorted(again, own)
        hit = own[(at < len(again)) & (again[np.minimum(at, len(again) - 1)] == own)] if len(again) else own[:0]
        if len(hit):
            rows.append((chunk, r, pack_sorted(hit)))
    return _rows(_TOLD_ARROW, rows)


def _doc_ids(table: pa.Table) -> np.ndarray:
    """doc_id of each row; a null id orders last."""
    return table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy()


def _starts(hashes: np.ndarray, more: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by window, document and word; place in it of each window's first entry)."""
    order = np.lexsort((at, doc, more, hashes))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, np.flatnonzero(new)


def _candidates(window: int, ranges: int, cells: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if table.num_rows == 0 or told.num_rows == 0:
            return _rows(_FOUND_ARROW, [])
        chunk = table["chunk"][0].as_py()
        docs = _doc_ids(table)
        words, hashes, at, first = _windows(table, window)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rng, cell = _cell(hashes, ranges, cells)
        again = {r: unpack_sorted(c) for r, c in zip(told["rng"].to_pylist(), told["cells"].to_pylist(), strict=True)}
        more = more_bits(words, window)
        rows = []
        for r, i in _by_range(rng):
            if r not in again:
                continue
            seen = again[r]
            p = np.searchsorted(seen, cell[i])
            i = i[(p < len(seen)) & (seen[np.minimum(p, len(seen) - 1)] == cell[i])]
            # a second, independent hash of the same words: 64 + 32 bits decide equality
            second = more[words.first[text[i]] + at[i]]
            order, lead = _starts(hashes[i], second, docs[text[i]], at[i])
            own = order[lead]
            out = np.empty(len(own), dtype=_FIRST)
            out["hash"], out["more"], out["id"], out["at"] = hashes[i][own], second[own], docs[text[i]][own], at[i][own]
            rows.append((chunk, r, out.tobytes()))
        return _rows(_FOUND_ARROW, rows)

    return run


def more_bits(words: Words, window: int) -> np.ndarray:
    """32 more bits of the window that starts at each word, from other sums than the first 64 bits."""
    own = mix(words.hashes(), 0xABCDEF)
    out = np.zeros(max(0, len(own) - window + 1), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(window):
            out = out * U(0xD6E8FEB86659FD93) + own[k : k + len(out)]
    return (mix(out, 0x5555) >> U(32)).astype(np.uint32)


def _exact(table: pa.Table) -> pa.Table:
    """Of one range: to each chunk, the windows that start earlier in another chunk."""
    r = table["rng"][0].as_py()
    parts = [np.frombuffer(x, _FIRST) for x in table["first"].to_pylist()]
    chunk = np.repeat(table["chunk"].to_numpy(), [len(p) for p in parts])
    every = np.concatenate(parts)
    order, lead = _starts(every["hash"], every["more"], every["id"], every["at"])
    least = order[np.repeat(lead, np.diff(np.append(lead, len(order))))]
    later = (every["id"][order] != every["id"][least]) | (every["at"][order] != every["at"][least])
    late = np.sort(order[later])  # chunk by chunk
    out = np.empty(len(late), dtype=_WINDOW)
    out["hash"], out["more"], chunk = every["hash"][late], every["more"][late], chunk[late]
    return _rows(_GOES_ARROW, [(int(chunk[a]), r, out[a:b].tobytes()) for a, b in _runs(chunk)])


def _covered(words: Words, docs: np.ndarray, late: np.ndarray, window: int) -> np.ndarray:
    """Which words a window that goes covers; ``late``: windows that start earlier in another chunk."""
    n = len(words.starts)
    hashes, at, first = grams(words, window, short_as_one=False)
    if not len(hashes):
        return np.zeros(n, dtype=bool)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = words.first[text] + at
    more = more_bits(words, window)[start]
    doc = docs[text]
    order, lead = _starts(hashes, more, doc, at)
    size = np.diff(np.append(lead, len(order)))
    least = order[np.repeat(lead, size)]
    goes = (doc[order] != doc[least]) | (at[order] != at[least])
    if len(late):
        late = np.sort(late, order=["hash", "more"])
        own = np.empty(len(lead), dtype=_WINDOW)
        own["hash"], own["more"] = hashes[order[lead]], more[order[lead]]
        # windows are in order of hash and more; a pair of both is looked up by its hash, then by more
        spot = np.searchsorted(late["hash"], own["hash"], "left")
        end = np.searchsorted(late["hash"], own["hash"], "right")
        told = np.zeros(len(own), dtype=bool)
        for step in range(int((end - spot).max(initial=0))):
            k = np.minimum(spot + step, len(late) - 1)
            told |= (spot + step < end) & (late["more"][k] == own["more"])
        goes |= np.repeat(told, size)
    step = np.zeros(n + 1, dtype=np.int64)
    gone = start[order[goes]]  # each start once
    step[gone] += 1
    step[gone + window] -= 1
    return np.cumsum(step)[:-1] > 0


def _cut_out(data: np.ndarray, text_end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of each text that lie in the spans, without white space at its end."""
    step = np.zeros(len(data) + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8) > 0
    size = np.concatenate([[0], np.cumsum(mask)])
    bounds = np.concatenate([[0], size[text_end]])
    view = memoryview(data[mask])
    return [bytes(view[a:b]).rstrip(b" \t\n\x0b\x0c\r") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def kept_words(words: Words, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text joined by one space."""
    data = words.data.copy()
    data[words.ends[keep]] = 0x20
    return _cut_out(data, words.text_end, words.starts[keep], words.ends[keep] + 1)


def kept_spans(words: Words, keep: np.ndarray) -> list[bytes]:
    """Kept words of each text, each with the white space after it in the text."""
    text = np.searchsorted(words.text_end, words.starts, "right")
    until = np.append(words.starts[1:], len(words.data))
    until = np.minimum(until, words.text_end[text]) if len(text) else until[:0]
    return _cut_out(words.data, words.text_end, words.starts[keep], until[keep])


def _digest(table: pa.Table, words: Words, covered: np.ndarray, removed: np.ndarray) -> pa.Table:
    return pa.table({
        "doc_id": table["doc_id"],
        "n_words": pa.array(words.counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept_words(words, ~covered)], pa.string()),
    })


def _rewrite(table: pa.Table, words: Words, covered: np.ndarray, removed: np.ndarray) -> pa.Table:
    """Rows with their text cut; a text that loses nothing stays as it is."""
    kept, text = kept_spans(words, ~covered), table["text"].to_pylist()
    out = [kept[i].decode() if removed[i] else text[i] for i in range(len(text))]
    return table.drop_columns(["chunk", "key"]).set_column(table.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def _apply(window: int, output):
    def run(table: pa.Table, goes: pa.Table) -> pa.Table:
        words = words_of(table["text"])
        late = np.frombuffer(b"".join(goes["windows"].to_pylist()), _WINDOW)
        covered = _covered(words, _doc_ids(table), late, window)
        gone = np.concatenate([[0], np.cumsum(covered)])
        return output(table, words, covered, gone[words.first[1:]] - gone[words.first[:-1]])

    return run


def _dedup(docs: DataFrame, window: int, output, schema: str | StructType) -> DataFrame:
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = total / WORD_BYTES
    side = math.sqrt(windows * SHARED)
    chunks = max(64, math.ceil(total / min(max(CHUNK_BYTES, side * WORD_BYTES), MOST_CHUNK)))
    ranges = max(64, math.ceil(windows / min(max(RANGE_WINDOWS, side), MOST_RANGE)))
    cells = CELLS_PER_WINDOW * max(1, math.ceil(windows / ranges))
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    # by id and text, so that rows without an id are spread too
    by_chunk = keyed.withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(chunks)).cast("int")).groupBy("chunk")
    told = by_chunk.applyInArrow(lean_group(_sketch(window, ranges, cells)), _TOLD).groupBy("rng").applyInArrow(lean_group(_merge), _TOLD)
    found = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lean_cogroup(_candidates(window, ranges, cells)), _FOUND)
    goes = found.groupBy("rng").applyInArrow(lean_group(_exact), _GOES)
    return by_chunk.cogroup(goes.groupBy("chunk")).applyInArrow(lean_cogroup(_apply(window, output)), schema)


def dedup_substrings(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document.

    ``kept_sha256``: of the kept words joined by one space, in UTF-8.
    """
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return _dedup(docs, window, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with the words that go cut out of ``text``.

    Kept words keep the white space after them; a text that loses nothing
    stays as it is.
    """
    columns = documents.columns
    at = {name: columns.index(name) for name in ("doc_id", "text")}
    docs = documents.toDF(*(f"c{i}" for i in range(len(columns))))
    rest = [c for i, c in enumerate(docs.columns) if i not in at.values()]
    doc_id, text = F.col(f"c{at['doc_id']}").cast("long").alias("doc_id"), F.col(f"c{at['text']}").alias("text")
    docs = docs.select(doc_id, text, F.struct(*rest).alias("rest")) if rest else docs.select(doc_id, text)
    cut = _dedup(docs, window, _rewrite, docs.schema)
    back = {at["doc_id"]: F.col("doc_id"), at["text"]: F.col("text")}
    return cut.select(*((back[i] if i in back else F.col(f"rest.c{i}")).alias(f"c{i}") for i in range(len(columns)))).toDF(*columns)
