"""Filter interaction audit by the multilinear extension of the removal count.

Each document fails some of k filters: its mask. For a part of the corpus (a language, a source), let c[m] be its documents of mask m. If filter i is applied
with probability x[i], the expected number of kept documents is sum over m of c[m] * prod over i in m of (1 - x[i]); what is removed,

    R(x) = sum over non-empty sets S of r[S] * prod over i in S of x[i],   r[S] = (-1)^(|S|+1) * (documents that fail all of S),

is a polynomial that is linear in each variable. Its value at the corner of a set of filters is what that set removes; so survivors, removals by step and in any
order, and what one filter alone removes are differences of corners. The Shapley value of filter i is the integral of dR/dx[i] along the diagonal,
which is sum over S with i in S of r[S] / |S|; integrated with exact fractions and scaled by k! it is an integer, the filter's removals summed over all orders.

At scale: texts become narrow rows at the scan (mask, digest of the text); masks are counted with partial aggregation, so that 2^k counts per part are left.
The filter for copies needs no join of rows with their groups: of each digest, only the rows of the least id pass, and these are found by two aggregations
that combine before their shuffle; all other rows fail. A text that a third of all rows share is thus a row per task. Only the polynomial runs in Python, per part, on 2^k numbers.

Defined cases: null text is empty and has no words (it fails A; 0 < 0 is false for B and C); null parts are the empty string; a null id is greater than all others; rows that repeat an id
and its text are no copies of each other; several labels of a document count as one, which is 1 where any is; extra columns are ignored; an empty table gives no rows.
Texts are taken as identical if their SHA-256 is.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, text_of

COPIES = "E"


def text_filters(text_col: str = "text") -> dict[str, Column]:
    """Conditions under which a text fails, by letter. The words of `words` are reused, so that a text is split once."""
    text, n = text_of(text_col), F.size("_words")
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("_words")) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def words(text_col: str = "text") -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(text_of(text_col), f"{SPACE}+"), lambda w: w != "")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """(id, part, digest, mask): bit i of mask is set if the text fails the i-th filter. filters: by letter, conditions over the columns _text and _words; text_filters unless given."""
    fails = (filters or text_filters("_text")).values()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("_text")).withColumn("_words", words("_text"))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), bits.cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those of toxic 1, by part and mask; the highest bit is the filter for copies."""
    rows = cut(masked(docs, id_col, text_col, part_col, filters))
    copy = 1 << len(filters or text_filters())
    group = ["part", "mask"]
    # firsts: of each digest, the rows of the least id, by part
    ids = rows.groupBy("digest", F.col("id").isNull().alias("none"), "id", "part", "mask").agg(F.count("*").alias("n"))
    ids = ids.groupBy("digest", "none", "id").agg(F.first("mask").alias("mask"), F.collect_list(F.struct("part", "n")).alias("parts"))
    firsts = ids.groupBy("digest").agg(F.min(F.struct("none", "id", "mask", "parts")).alias("x")).select("x.id", "x.mask", F.explode("x.parts").alias("p"))
    firsts = firsts.select("id", F.col("p.part").alias("part"), "mask", F.col("p.n").alias("n"), F.lit(True).alias("first"))
    every = rows.groupBy("id", *group).agg(F.count("*").alias("n")).withColumn("first", F.lit(False))
    both = firsts.select("id", *group, "n", "first").unionByName(every.select("id", *group, "n", "first"))
    if labels is None:
        both = both.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        given = labels.groupBy(F.col(id_col).alias("_lid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        both = both.join(given, both["id"] == given["_lid"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    counted = both.groupBy("first", *group).agg(*sums)
    # all rows as copies, less the firsts, which pass
    signed = F.explode(F.when(F.col("first"), F.array(F.struct(F.lit(0).alias("bit"), F.lit(1).alias("sign")), F.struct(F.lit(copy).alias("bit"), F.lit(-1).alias("sign")))).otherwise(F.array(F.struct(F.lit(copy).alias("bit"), F.lit(1).alias("sign")))))
    moved = counted.withColumn("x", signed).select("part", (F.col("mask") + F.col("x.bit")).alias("mask"), *((F.col(c) * F.col("x.sign")).alias(c) for c in ("n", "good", "toxic")))
    return moved.groupBy(*group).agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).where("n > 0")


class Removal:
    """The removal polynomial of one part. Coefficients by set of filters, sets as bit masks."""

    def __init__(self, counts: list[int], filters: int):
        self.filters = filters
        failing = list(counts)  # of each set, the documents that fail all of it: sums over supersets
        for i in range(filters):
            for s in range(1 << filters):
                if not s >> i & 1:
                    failing[s] += failing[s | 1 << i]
        self.failing = failing
        self.coefficients = [0 if not s else failing[s] if s.bit_count() % 2 else -failing[s] for s in range(1 << filters)]
        corners = list(self.coefficients)  # at each corner, the sum over subsets
        for i in range(filters):
            for s in range(1 << filters):
                if s >> i & 1:
                    corners[s] += corners[s ^ 1 << i]
        self.corners = corners

    def removed(self, chosen: int) -> int:
        """Documents that the chosen filters remove together."""
        return self.corners[chosen]

    def shapley(self, i: int) -> Fraction:
        """Integral of the partial derivative by variable i along the diagonal."""
        return sum((Fraction(r, s.bit_count()) for s, r in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


def part_report(counts: dict[str, list[int]], letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters; counts: by mask, of n, good and toxic."""
    k = len(letters)
    n, good, toxic = (Removal(counts[c], k) for c in ("n", "good", "toxic"))
    total, full = n.failing[0], (1 << k) - 1
    shares = [n.shapley(i) * factorial(k) for i in range(k)]
    if any(x.denominator != 1 for x in shares):
        raise ArithmeticError("a Shapley value times k! is an integer")
    for order in permutations(range(k)):
        chosen = 0
        for step, i in enumerate(order, 1):
            after = chosen | 1 << i
            lost = n.removed(after) - n.removed(chosen)
            yield (
                "".join(letters[j] for j in order), step, total - n.removed(after), lost, n.failing[1 << i] - lost, n.removed(full) - n.removed(full ^ 1 << i),
                good.removed(after) - good.removed(chosen), toxic.removed(after) - toxic.removed(chosen), int(shares[i]),
            )
            chosen = after


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: dict[str, Column] | None = None) -> DataFrame:
    """One row per part, order of the filters (the given ones and that for copies) and step; zeros included."""
    letters = "".join(filters or text_filters()) + COPIES
    if len(letters) > 8 or len(set(letters)) < len(letters):
        raise ValueError("seven filters of different letters, E not among them, at most: their orders are all listed")
    masks = 1 << len(letters)
    counts = mask_counts(docs, labels, id_col, text_col, part_col, filters)
    of = lambda c: F.array(*(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(masks)))
    parts = counts.groupBy("part").agg(*(of(c).alias(c) for c in ("n", "good", "toxic")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in REPORT.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                lists = {c: [int(x) for x in getattr(row, c)] for c in ("n", "good", "toxic")}
                yield pd.DataFrame([(row.part, *x) for x in part_report(lists, letters)], columns=names)

    return parts.mapInPandas(run, REPORT)
