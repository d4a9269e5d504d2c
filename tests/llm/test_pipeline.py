import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from basketlens.llm import language_id
from basketlens.llm.queries import QUERIES
from tests.llm.test_decontaminate import brute_force as contained
from tests.llm.test_jaccard_join import brute_force as linked
from tests.llm.test_substring_dedup import WORD

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.dtypes == docs.dtypes
        kept.append(out.cache())
    language, near, cut, clean = ([(r.doc_id, r.text) for r in d.collect()] for d in kept[1:])
    assert sorted(language) == sorted((r.doc_id, r.text) for r in docs.collect())  # all are in known languages
    assert sorted(d for d, _ in near) == sorted({r[2] for r in linked(language)})
    first, gone = {}, {}
    words = {d: WORD.findall(t) for d, t in near}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            if first.setdefault(tuple(words[d][i : i + 20]), (d, i)) < (d, i):
                gone.setdefault(d, set()).update(range(i, i + 20))
    assert gone and {d: WORD.findall(t) for d, t in cut} == {d: [x for i, x in enumerate(w) if i not in gone.get(d, ())] for d, w in words.items()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in contained(cut, items)}
    assert bad and sorted(clean) == sorted(x for x in cut if x[0] not in bad)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in clean}
    assert all(zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "!!", None, None, 2), (3, "the and of " * 30, "en", None, None), (3, "the and of " * 30, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in docs.collect()} == {3}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_names_that_differ_in_case(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("doc_id", "text", "lang", "source", "n_chars", "'x' as Text", "1 as N_CHARS")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "Text", "N_CHARS"]
    assert all(r[4] == len(r[1]) for r in docs.collect())


def test_first_stage_learns_from_all_its_documents(spark, monkeypatch):
    """Every character of the documents that are not held out is counted, and all of them make the limits."""
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abcde"), rng.integers(5, 40))), "p", "s", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    trained, used, train, accepted = [], [], language_id.train, language_id.accepted
    monkeypatch.setattr(language_id, "train", lambda grams, counts: trained.append((int(counts.sum()), train(grams, counts))) or trained[-1][1])
    monkeypatch.setattr(language_id, "accepted", lambda d, models: used.append(models) or accepted(d, models))
    kept = corpus_pipeline.known_language(spark, docs, SF)
    texts = [[t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 4 != 2 and half[i] == k] for half in [dict(docs.selectExpr("doc_id", f"pmod(xxhash64(doc_id, text, 23), {1 << 29}) % 2").collect())] for k in (0, 1)]
    sizes = [np.array([len(t) for t in own]) for own in texts]
    assert trained[0][0] == sizes[0].sum() + sizes[1].sum()
    assert [n for n, _ in trained[1:]] == [sizes[1].sum(), sizes[0].sum()]  # without the first half, without the second
    h = [language_id.cross_entropies([model], own)[0][:, 0] for (_, model), own in zip(trained[1:], texts, strict=True)]
    assert np.isclose(used[0].mean[0], np.average(np.concatenate(h), weights=np.concatenate(sizes)))
    assert kept.count() >= 1999


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
