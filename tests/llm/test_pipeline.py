import os

import pytest

import corpus_pipeline
from fieldloom.llm import bpe, language, ngram_join

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, before, FOLDER))
        assert after.columns == columns
        if name == "language_id":
            gone = before.join(after, "doc_id", "left_anti").select("text").collect()
            assert len(gone) <= 0.05 * before.count()
        if name == "near_duplicates":
            groups = ngram_join.ngram_components(before, corpus_pipeline.WIDTH, corpus_pipeline.SIMILARITY).collect()
            assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in groups}
        if name == "pii_surrogates":
            assert after.count() == before.count() and after.filter("n_chars <> length(text)").isEmpty()
        before = after
    rows = corpus_pipeline.bpe_tokens(spark, before, FOLDER).collect()
    codec = bpe.codec(bpe.default_vocabulary())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert len(rows) == before.count() and all(r["ids"] == codec.encode(texts[r["doc_id"]]).tolist() for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "pii_surrogates", "source_mix", "bpe_tokens"]
    assert language.UNKNOWN == "und"


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven old sailors sing about rain and distant harbours".split()


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def _said(k):
    return " ".join(WORDS[k:] + WORDS[:k]) + f" number {k}"


def test_null_and_repeated_ids_in_near_duplicates(spark):
    one, two, three, four = (_said(5 * k) for k in range(4))
    docs = _docs(spark, [(7, one, "a"), (7, one, "a"), (8, one, "b"), (7, two, "a"), (None, three, "a"), (None, three, "b"), (None, one, "a"), (None, four, "a"), (9, None, "a"), (9, None, "a"), (None, "", "a")])
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect())
    assert kept == sorted([("7", one), ("7", two), ("None", three), ("None", four), ("9", ""), ("None", "")])


def test_null_and_repeated_ids_in_source_mix(spark):
    texts = [(1, _said(1), "a"), (1, "short text here", "b"), (1, "short text here", "b"), (None, _said(2), "a"), (None, "two words", "c"), (2, _said(3), "c"), (2, _said(3), "c"), (1, _said(4), "c")]
    docs = _docs(spark, texts)
    after = corpus_pipeline.source_mix(spark, docs, FOLDER)
    taken = corpus_pipeline.mixing.mix(docs).collect()
    uses = sum(-(-r["taken"] // r["size"]) for r in taken if r["taken"])
    assert after.columns == docs.columns and after.count() == uses
    expected = {}
    for r in taken:
        if r["taken"]:
            at = (r["doc_id"], r["source"], r["size"])
            expected[at] = expected.get(at, 0) + -(-r["taken"] // r["size"])
    found = {}
    for r in after.collect():
        at = (r["doc_id"], r["source"], len(r["text"].split()))
        found[at] = found.get(at, 0) + 1
    assert found == expected and any(at[0] is None for at in found)


def test_null_and_repeated_ids_in_the_other_stages(spark):
    rows = [(1, _said(1) + " call +1 415 555 2671", "a"), (1, _said(2) + " Mr Bob Smith", "a"), (None, _said(3), "a"), (None, _said(4) + " Mr Smith", "a"), (1, _said(1) + " call +1 415 555 2671", "a")]
    docs = _docs(spark, rows)
    assert corpus_pipeline.language_id(spark, docs, FOLDER).count() == len(rows)
    clean = corpus_pipeline.pii_surrogates(spark, docs, FOLDER).collect()
    assert sorted(r["text"].split(" number ")[0] for r in clean) == sorted(t.split(" number ")[0] for _, t, _ in rows)
    codec = bpe.codec(bpe.default_vocabulary())
    tokens = corpus_pipeline.bpe_tokens(spark, docs, FOLDER).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in tokens) == sorted((str(i), codec.encode(t).tolist()) for i, t, _ in rows)
