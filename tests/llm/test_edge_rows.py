"""Every text operator on the same edge rows: nulls, empty and very long texts, repeated rows, extra columns with clashing
names, and an empty table."""

from __future__ import annotations

import public_tokenizers
import pytest

from solvara.llm import language, packing, pii, quality, simhash, token_counts, toxicity, url_filter

VOCAB = public_tokenizers.path("word_bpe_49k.json")
NAMES = ["fp", "component_id", "ids", "part", "inner", "n", "label", "score", "predicted", "held_out", "lang_pred", "spans", "kept", "n_tokens", "h", "id", "l", "r"]


@pytest.fixture
def clashing(docs, edge_rows):
    rows = [*edge_rows, (7, "twice the same text"), (8, "twice the same text"), (9, "long " * 60_000)]
    frame = docs([(*r[:2], "en", "s", *range(len(NAMES))) for r in rows], "".join(f", {n} int" for n in NAMES))
    return frame, [r[0] for r in rows]


def _ids(result):
    return sorted((r.doc_id for r in result.select("doc_id").collect()), key=str)


@pytest.fixture
def models(spark, docs):
    texts = [(i, ("you stupid zorgwit. " if i % 2 else "a quiet morning by the river. ") * (1 + i % 5) + f"call +1 555 010 {i:04} or a{i}@b.org", "en" if i % 3 else "fr")
             for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(3, 0, 1)] * 5, "doc_id long, toxic int, quality int")
    return docs(texts), labels


def test_fitted_operators(clashing, models):
    frame, ids = clashing
    texts, labels = models
    fitted = [
        lambda d: toxicity.score_toxicity(d, toxicity.train(texts, labels)), lambda d: quality.judge_quality(d, quality.train(texts, labels)),
        lambda d: pii.find_pii(d, pii.train(texts)), lambda d: language.identify_language(d, language.train_dictionaries(texts))]
    for operator in fitted:
        result = operator(frame)
        assert _ids(result) == sorted(ids, key=str)
        by_id = {}
        for r in result.collect():
            by_id.setdefault(r.doc_id, set()).add(tuple(r)[1:])
        assert len(by_id[3]) == 1                      # repeated rows are judged alike
        assert {t[1:] for t in by_id[7]} == {t[1:] for t in by_id[8]}  # and so are equal texts, but for held_out
        assert operator(frame.limit(0)).count() == 0


def test_unfitted_operators(clashing):
    frame, ids = clashing
    pieces = packing.pack(frame, VOCAB)
    assert sorted((r.doc_id for r in pieces.where("start = 0").collect()), key=str) == sorted(ids, key=str)
    assert _ids(token_counts.count_document_tokens(frame, VOCAB)) == sorted(ids, key=str)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert found[7] == found[8] == 7 and found[1] == found[2] == found[4]
    for operator in (lambda d: packing.pack(d, VOCAB), lambda d: token_counts.count_document_tokens(d, VOCAB), simhash.near_duplicates):
        assert operator(frame.limit(0)).count() == 0


def test_very_long_url(spark):
    long = "http://" + "a." * 40_000 + "example.org/es/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long, 0), (2, long, 0), (3, "http://" + "h" * 300_000, 0)], "page_id long, url string, rule int")
    listed = spark.createDataFrame([("h" * 300_000,)], "key string")
    got = {r.page_id: (r["verdict"], len(r["host"])) for r in url_filter.judge_urls(pages.drop("rule"), listed).collect()}
    assert got == {1: ("block", 80_011), 2: ("block", 80_011), 3: ("block", 300_000)}
