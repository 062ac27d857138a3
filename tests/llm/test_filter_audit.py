"""The audit against applying the filters one by one, on rows with nulls, ties, repeated rows and long texts."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import filter_audit

GOOD = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (2, GOOD, "en"), (2, GOOD, "de"), (3, GOOD + " $", "en"), (4, "same " * 300, "en"), (5, "same " * 300, None), (6, None, None), (7, "", ""), (8, "AAAA " * 300, "de"), (9, GOOD.upper(), "de"),
    (None, GOOD, "fr"), (None, "alone", "fr"), (None, "alone", "fr"), (10, GOOD + "\x0b\xa0#", "en"), (2**53 + 1, GOOD + "x", "en"), (11, "long words here " * 50_000, "es"), (1, GOOD, "fr"), (12, "*", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (9, 0, 1), (4, None, 1), (None, 1, 1), (2**53 + 1, 1, 0)]


def brute(rows, labels):
    texts: dict = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = [j for j in texts[t] if j is not None and (i is None or j < i)]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(smaller)}
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = set(), {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                own = [d for d in docs if d[0] == part]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out.add((part, "".join(order), step, len(left), len(here), sum(f in d[1] for d in own) - len(here), sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


def test_against_applying_the_filters(spark):
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in ROWS], "doc_id bigint, text string, lang string, mask int, part int, n int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) == 5 * 600
    assert set(got) == brute(ROWS, LABELS)


def test_without_labels_own_filters_and_empty(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b b", "x")], "doc_id bigint, text string, lang string")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in filter_audit.audit(docs, filters={"Z": F.size("_words") < 2}).collect()}
    assert got == {("ZE", 1): (1, 2, 3), ("ZE", 2): (1, 0, 1), ("EZ", 1): (2, 1, 1), ("EZ", 2): (1, 1, 3)}
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=16, max_size=16))
def test_the_polynomial(counts):
    """Corners and Shapley values of four filters against sums over masks and over all orders."""
    r = filter_audit.Removal(counts, 4)
    assert all(r.removed(s) == sum(c for m, c in enumerate(counts) if m & s) for s in range(16))
    for i in range(4):
        total = 0
        for order in permutations(range(4)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += r.removed(before | 1 << i) - r.removed(before)
        assert r.shapley(i) == Fraction(total, factorial(4))
    assert sum(r.shapley(i) for i in range(4)) == r.removed(15)
