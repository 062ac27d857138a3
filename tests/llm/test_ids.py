"""Ids over 2^53, negative ones and null stay what they are in every operator that runs in Arrow batches, and in the near stage; components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, jaccard, ngram_lm, packing, prefix_hash, quality_crf, queries, secret_scan, simhash, substring_dedup

IDS = [2**53 + 1, 2**53 + 3, -(2**60) - 1, None, 5]
TEXT = "token = 'a8f7d6s5k3j2h1g0q9w8' and some more words that make up a line of more than thirteen words, so it counts."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT + f" Document {k}.\nSecond line {k}.") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)


def _scored(docs):
    return ngram_lm.score(docs, ngram_lm.train(docs))


def _chain(spark):
    labelled = [("good long text with words. " * 9, 1), ("#### $$$$", 0)] * 20
    return quality_crf.fit_chain([t for t, _ in labelled], np.array([y for _, y in labelled]))


RUN = {
    "prefix_hash": lambda s, d: prefix_hash.edited_fingerprints(d),
    "secret_scan": lambda s, d: secret_scan.scan(d, secret_scan.train(s, secret_scan.labelled_findings(200))),
    "ngram_lm": lambda s, d: _scored(d),
    "substring_dedup": lambda s, d: substring_dedup.span_report(d),
    "simhash": lambda s, d: simhash.simhash_groups(d),
    "quality_crf": lambda s, d: quality_crf.score(d, _chain(s)),
    "packing": lambda s, d: packing.pack(d, queries.word_tokenizer()).dropDuplicates(["doc_id"]),
    "jaccard": lambda s, d: jaccard.jaccard_groups(d),
}


@pytest.mark.parametrize("name", list(RUN))
def test_ids_stay(spark, docs, name):
    got = RUN[name](spark, docs)
    assert got.schema["doc_id"].dataType.simpleString() == "bigint"
    found = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert found == set(IDS)


def test_copies_with_large_ids_go(spark):
    """Of equal rows with an id over 2^53, beside a null id, one stays."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(2**53 + 1, text), (2**53 + 1, text), (None, "other words here that nobody else has at all"), (7, text + " thirteen")], "doc_id bigint, text string").coalesce(1)
    assert sorted(map(str, (r["doc_id"] for r in jaccard.drop_alike(docs).collect()))) == ["7", "None"]
    assert simhash.drop_near_copies(docs.where("doc_id is null or doc_id > 7")).count() == 2


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_components(spark, most):
    rng = random.Random(4)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(2**53 + i, 2**53 + i + 1) for i in range(150)] + [(3, 3), (-5, 2**60)]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in root)
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7).withColumn("node", F.lit(1))
    assert sorted(map(tuple, components.components(table, most_edges=most).collect())) == want
    assert components.components(table.where("false")).count() == 0


def test_common_lines_are_sent(spark, monkeypatch):
    """A line that many documents have, by either way of meeting its rows."""
    line = "this very common line has quite a few words so that it is a unit of its own"
    docs = spark.createDataFrame([(i, f"{line}\nand line {i} here is another one that has many words but is not shared at all") for i in range(60)], "doc_id bigint, text string")
    want = sorted(map(str, substring_dedup.span_report(docs).collect()))
    monkeypatch.setattr(substring_dedup, "MOST_FREQUENT", 1 << 40)
    real = max
    monkeypatch.setattr("builtins.max", lambda *a, **k: 5 if a[:1] == (1_000,) else real(*a, **k))
    got = sorted(map(str, substring_dedup.span_report(docs).collect()))
    monkeypatch.undo()
    assert got == want and sum("n_removed=1" in r for r in got) == 59


def test_whole_names_before_values(spark):
    text = "token_for_the_production_cluster_of_emea_and_everything_else = Tr0ub4dor&3"
    assert [text[a:b] for a, b in secret_scan.candidates(text)] == ["Tr0ub4dor&3"]
    assert not list(secret_scan.candidates("key" * 200_000))  # in linear time


def test_a_long_labelled_text_is_skipped(spark):
    docs = spark.createDataFrame([(1, "x " * 9_000), (2, "good words. " * 5), (3, "## $$ ##")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, quality int")
    assert quality_crf.fit(docs, labels, sample_chars=4_000) is not None
