"""Every stage of the pipeline against brute force on its own input, and run() against the stages one after the other."""

import os
import re
import sys
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as cp
from tessera.llm import quality_crf, queries

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard import brute  # noqa: E402

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        at[name] = (docs.collect(), (docs := spark.read.parquet(f"{tmp_path}/{k}")).collect())
    before, after = at["quality"]
    chain = quality_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = dict(zip((r["doc_id"] for r in before), quality_crf.score_texts(chain, [r["text"] or "" for r in before])))
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, s in scores.items() if s >= 0.5)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - {r["doc_id"] for r in after}) <= 0.02 * len(good)

    before, after = at["exact"]
    first = {}
    for r in before:
        key = SPACES.sub(" ", r["text"] or "")
        first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())

    before, after = at["near"]
    assert sorted(r["doc_id"] for r in after) == brute(before)  # every link of 0.8 or more on five-word shingles

    before, after = at["mix"]
    times = Counter(r["doc_id"] for r in after)
    assert set(times) == {r["doc_id"] for r in before} and max(times.values()) <= 2
    assert {r for r in after} == {r for r in before}

    before, after = at["pack"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    want = Counter()
    for r in before:
        ids, start = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], np.uint32), 0
        while start < len(ids):
            n = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            want[r["doc_id"], start, n, zlib.crc32(ids[start : start + n].tobytes()), tuple(ids[start : start + n].tolist())] += 1
            start += n
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in after) == want
    assert sorted(r["sequence_id"] for r in after) == list(range(len(after)))

    whole = cp.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"]) for r in whole) == Counter((r["doc_id"], r["start"], r["ids_crc32"], r["sequence_id"]) for r in after)
