"""Mined negatives against brute force: nulls, odd components, ties, repeated rows, vectors of other lengths, several blocks and buckets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, block int, pos int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    usable = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if all(abs(x) <= hard_negatives.largest(len(q)) and abs(x) < 2**31 for x in q):
            usable[i, label, q] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, q in [u for u in usable if anchor(u[0])]:
        scored = sorted((-dot(q, w), j, m) for j, m, w in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            band = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(band, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, F.col("id") % 10 == 0, **more).collect()
    return sorted(tuple(r) for r in got)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(12)], rng.randrange(4)) for i in range(600)]
    rows += [(600 + i, rows[5][1], 2) for i in range(40)]  # one vector many times: ties
    rows += [(1000, None, 1), (1010, [], 1), (1020, [0.1, None], 1), (1030, [float("nan"), 0.1], 1), (1040, [float("inf"), 0.1], 1), (1050, [0.5] * 12, None), (None, [0.5] * 12, 1), (1060, [1e30] * 12, 1)]
    rows += [(1070, [0.4] * 5, 1), (1080, [0.3] * 20, 2), (1090, [0.0] * 12, 3), (1100, [9000.0] * 12, 0), (1101, [-9000.0] * 12, 0), rows[3], rows[3], (-10, [0.2] * 12, 1)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 1000
    assert mined(spark, rows) == want
    assert mined(spark, rows, anchors_per_block=9, rows_per_bucket=50) == want  # many cells


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.5], 2), (4, [1.0], 2)]) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]


@pytest.mark.parametrize("scale", [1, 300, 1 << 20])
def test_planes_give_exact_scores(scale):
    """Whatever is dropped early, what is left has its exact score and nothing that qualifies is missing."""
    rng = np.random.default_rng(scale)
    rows, anchors = rng.integers(-scale, scale + 1, (700, 9)), rng.integers(-scale, scale + 1, (6, 9))
    exact = rows @ anchors.T
    least = np.sort(exact, axis=0)[-5]
    allowed = np.ones(exact.shape, bool)
    at, of, got = hard_negatives.survivors(rows, anchors, allowed, lambda lo, hi, of: hi >= least[of], lambda lo, hi, alive: None)
    assert (got == exact[at, of]).all()
    assert set(zip(at.tolist(), of.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(exact >= least)), strict=True))
