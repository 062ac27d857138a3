"""The bigram model against a plain dictionary version; probabilities sum to one."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tessera.llm import ngram_lm


def brute(train, texts):
    words = lambda t: [w.decode("utf-8", "surrogatepass") for w in (t or "").encode("utf-8", "surrogatepass").lower().split()] + ["</s>"]
    pairs, c = Counter(), Counter()
    for t in train:
        w = words(t)
        c.update(w)
        pairs.update(zip(["<s>", *w], w))
    n, v = sum(c.values()), len(c)
    follow, cont, ctx = defaultdict(list), Counter(), Counter()
    for (h, w), k in pairs.items():
        follow[h].append(k)
        cont[w] += 1
        ctx[h] += k
    count = lambda x: [sum(1 for k in x if k == i) for i in (1, 2, 3, 4)]
    d, e = ngram_lm.discounts(*count(pairs.values())), ngram_lm.discounts(*count(cont.values()))
    off = lambda k, ds: ds[min(k, 3) - 1] if k else 0.0

    total = len(pairs)
    back = sum(off(k, e) for k in cont.values()) / max(total, 1)
    spare = {h: sum(off(x, d) for x in ks) for h, ks in follow.items()}

    def low(w):
        if not pairs:
            return 1 / (v + 1)
        return max(cont[w] - off(cont[w], e), 0) / total + back / (v + 1)

    def p(h, w):
        if not ctx[h]:
            return low(w)
        k = pairs[h, w]
        return max(k - off(k, d), 0) / ctx[h] + spare[h] / ctx[h] * low(w)

    out = []
    for t in texts:
        w = words(t)
        out.append((len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], w))))
    return out, p, c


def test_scores_match_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9001, None), (9002, ""), (9003, "Neverseen wordz"), (9004, "a a a a a a a a"), (9004, "a a a a a a a a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = [t for i, t in rows if crc32(str(i).encode()) % 7 != 2]
    from pyspark.sql import functions as F

    model = ngram_lm.train(df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), chars_per_shard=50_000)
    got = sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ngram_lm.score(df, model).collect())
    want = sorted((i, *x) for (i, _), x in zip(rows, brute(train, [t for _, t in rows])[0]))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_brute_force_sums_to_one():
    _, p, c = brute(["a b a c", "b b a", "c a b a"], [])
    for h in ("<s>", "a", "b", "nowhere"):
        assert sum(p(h, w) for w in c) + p(h, "unknown") == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    model = ngram_lm.train(empty)
    one = spark.createDataFrame([(1, "x y")], "doc_id bigint, text string")
    assert ngram_lm.score(one, model).first()["score"] == 0.0
    assert ngram_lm.score(empty, model).count() == 0


def test_query_by_hand(spark):
    """op5's own rows, with the training split made here."""
    from tessera.llm import queries

    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    out = lambda i: crc32(str(i).encode()) % 7 == 2
    want = brute([t for i, t in rows if not out(i)], [t for _, t in rows])[0]
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in queries.op5_ngram_lm(spark, "/root/testdata/sf0.001").collect())
    assert [g[:5] for g in got] == [(i, out(i), *w[:3]) for (i, _), w in zip(rows, want)]
    assert np.allclose([g[5:] for g in got], [w[3:] for w in want], rtol=1e-9)


def test_many_shards_and_few_descriptors(spark):
    """Over 2,000 shards, read by one process that may open 256 files."""
    import subprocess
    import sys

    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 900}" for j in range(60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = ngram_lm.train(df, chars_per_shard=50)
    assert model.bits >= 11
    code = """
import resource, pickle, sys
resource.setrlimit(resource.RLIMIT_NOFILE, (256, 256))
from tessera.llm import ngram_lm
model, rows = pickle.load(open(sys.argv[1], "rb"))
mapped = ngram_lm._Mapped(model, most=5000)
out = ngram_lm._scored(mapped, [ngram_lm.token_hashes(t) for _, t in rows])
assert len(mapped.files) > 2000
pickle.dump(out["score"].tolist(), open(sys.argv[2], "wb"))
"""
    import os
    import pickle
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        pickle.dump((model, rows), open(f"{d}/in", "wb"))
        subprocess.run([sys.executable, "-c", code, f"{d}/in", f"{d}/out"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
        scores = pickle.load(open(f"{d}/out", "rb"))
    want = brute([t for _, t in rows], [t for _, t in rows])[0]
    assert np.allclose(scores, [w[4] for w in want], rtol=1e-9)
