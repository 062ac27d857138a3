"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import pytest

import corpus_pipeline as cp
from tessera.llm import jaccard


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    """The ids that stay: the smallest of each component of pairs at 4/5 or more."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or (both and 9 * both >= 4 * (len(a) + len(sets[j]))):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r["doc_id"] for k, r in enumerate(rows) if find(k) == k]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_near_stage_on_tables(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    left = cp.near(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == brute(docs.collect())


def test_edits_common_lines_and_large_groups(spark, monkeypatch):
    """Copies at various numbers of edits, a line that all share, a group larger than COMMON; also where every shingle counts as common."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(6))
    line, texts = " ".join(word() for _ in range(20)), [None, "", " ", "one", "One"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(20, 200))]
        for _ in range(5):
            new = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                new[r.randrange(len(new))] = word()
            texts.append(line + "\n" + " ".join(new))
    base = [word() for _ in range(150)]
    for _ in range(60):
        new = list(base)
        for _ in range(r.randint(1, 4)):
            new[r.randrange(len(new))] = word()
        texts.append(" ".join(new))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    want = brute(docs.collect())
    assert 12 < len(want) < 60
    assert sorted(x["doc_id"] for x in jaccard.drop_alike(docs).collect()) == want
    monkeypatch.setattr(jaccard, "COMMON", 1)
    monkeypatch.setattr(jaccard, "AGREE", 17)  # nothing merged beforehand
    assert sorted(x["doc_id"] for x in jaccard.drop_alike(docs).collect()) == want
    assert jaccard.drop_alike(docs.where("false")).count() == 0
