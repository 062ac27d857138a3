"""Nulls, long texts, clashing columns and repeated rows where the other files don't have them: the language model, the near stage, the mix stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, ngram_lm

LONG = " ".join(f"w{i % 997}" for i in range(300_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c a b"), (2, None), (None, "a b c"), (None, None), (3, ""), (3, ""), (2**53 + 1, LONG), (4, "A B C \t\n"), (5, "é \U0001f600 x")]
    clash = {c: F.lit("x") for c in ("id", "score", "n_tokens", "text_key", "node", "root", "fp", "h", "shard", "words")}
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(clash)


def test_language_model(spark, docs):
    model = ngram_lm.train(docs)
    got = ngram_lm.score(docs, model).collect()
    assert len(got) == 9 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    of = lambda i: [r for r in got if r["doc_id"] == i]
    assert [r["n_tokens"] for r in of(2)] == [1] and [r["n_tokens"] for r in of(3)] == [1, 1] and sorted(r["n_tokens"] for r in of(None)) == [1, 4] and of(2**53 + 1)[0]["n_tokens"] == 300_001
    assert of(4)[0]["score"] == [r["score"] for r in of(None) if r["n_tokens"] == 4][0]  # A-Z lower-cased, white space alike
    model.delete(spark)
    none = docs.where("false")
    assert ngram_lm.score(none, ngram_lm.train(none)).count() == 0


def test_near_stage(docs):
    left = jaccard.drop_alike(docs)
    assert left.columns == docs.columns
    # empty texts and repeated rows are one; the texts of one shingle are alike only if equal
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(map(str, [1, 2, 4, 5, 2**53 + 1]))
    assert jaccard.drop_alike(docs.where("false")).count() == 0


def test_mix_stage_keeps_the_documents_own_columns(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 4), "s" * (1 + i % 2), f"own {i}", i) for i in range(20)], "doc_id bigint, text string, source string, position string, n_tokens int")
    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    assert all(r["position"] == f"own {r['doc_id']}" and r["n_tokens"] == r["doc_id"] for r in out.collect())
    assert {r["doc_id"] for r in out.collect()} == set(range(20))
