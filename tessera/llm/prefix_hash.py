"""Document fingerprints from prefix polynomial hashes.

For a text of code points c, the prefix array is H[i] = sum of (c[j] + 1) * B^j for j < i, modulo a prime, for two primes of 31 bits. The
hash of any span is (H[j] - H[i]) / B^i, one subtraction and one product with a tabulated inverse power; so any two spans of any two texts
are compared in constant time, and the longest common extension from two positions is found by binary search.

A fingerprint is the length, the hash of the whole text, and a sketch: the span hashes of all windows of `window` code points,
reduced to the smallest per slot of `slots` slots (one-permutation minhash, 16 bits kept per slot). The likeness of two fingerprints is 1
for equal length and hash, else the share of their windows in common, 2J / (1 + J) for the estimated Jaccard index J.

Defined cases: null text is empty; a text shorter than the window has one window; rows are in the order of (id, text key), null ids first;
the only row of a table is its own next one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import in_batches, partitions, text_of

#: Two primes below 2^31 and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0 ... B^n and their inverses; the tables of a worker grow by doubling."""
    have = _POWERS.get(k)
    if have is None or len(have[0]) <= n:
        size, p = 1 << max(12, int(n).bit_length()), PRIMES[k]
        out = []
        for base in (BASES[k], pow(BASES[k], -1, p)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), p)) % np.uint64(p)])
            out.append(table)
        _POWERS[k] = have = (out[0], out[1])
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str | np.ndarray) -> None:
        points = code_points(text) if isinstance(text, str) else text
        self.points, self.n, self.prefix = points, len(points), []
        wide = points.astype(np.uint64) + np.uint64(1)
        for k, p in enumerate(PRIMES):
            terms = wide * _powers(k, self.n)[0][: self.n] % np.uint64(p)
            self.prefix.append(np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)))  # exact for up to 2^33 points

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """62-bit hashes of the spans [start, start + length)."""
        out = []
        for k, p in enumerate(PRIMES):
            h = self.prefix[k]
            out.append((h[start + length] + np.uint64(p) - h[start]) % np.uint64(p) * _powers(k, self.n)[1][start] % np.uint64(p))
        return out[0] << np.uint64(31) | out[1]

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])

    def equal(self, start: int, other: PrefixHashes, other_start: int, length: int) -> bool:
        return self.span(start, length) == other.span(other_start, length)

    def extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Longest common extension to the right of two positions."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, other_start, mid) else (low, mid - 1)
        return low


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: PrefixHashes, window: int = 24, slots: int = 128) -> str:
    """'length:whole:sketch' in hexadecimal; a slot that no window meets is ffff."""
    n, width = hashes.n, min(window, hashes.n)
    mixed = _mixed(hashes.spans(np.arange(max(1, n - width + 1)), width))
    slot, value = (mixed % np.uint64(slots)).astype(np.int64), mixed >> np.uint64(8)
    least = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, value)
    kept = np.where(least == np.iinfo(np.uint64).max, np.uint64(0xFFFF), least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))
    kept = np.where((kept == 0xFFFF) & (least != np.iinfo(np.uint64).max), np.uint64(0xFFFE), kept)
    return f"{n:x}:{hashes.span(0, n):016x}:{kept.astype('>u2').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """0 to 1."""
    (n, whole, x), (m, other, y) = a.split(":"), b.split(":")
    if (n, whole) == (m, other):
        return 1.0
    u, v = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (x, y))
    used = (u != 0xFFFF) | (v != 0xFFFF)
    j = float((u[used] == v[used]).mean()) if used.any() else 0.0
    return 2 * j / (1 + j)


def _placed(heads: pd.DataFrame):
    """heads (id, none, k), sorted, null ids first: what cuts rows into buckets. -> f(ids, are they null?, keys) giving (bucket, is the row the head of its bucket?)."""
    none = int(heads["none"].sum())
    of_none, known, keys = heads["k"].to_numpy(np.int64)[:none], heads["id"].to_numpy()[none:], heads["k"].to_numpy(np.int64)[none:]

    def place(ids: pd.Series, missing: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.searchsorted(of_none, k, "right")
        some = np.flatnonzero(~missing)
        values = ids.iloc[some].to_numpy(dtype=known.dtype)
        low, high = (np.searchsorted(known, values, side) for side in ("left", "right"))
        at = low.copy()
        for i in np.flatnonzero(high > low):  # ids that are a head's own: the text key decides
            at[i] += np.searchsorted(keys[low[i] : high[i]], k[some[i]], "right")
        bucket[some] = none + at
        bucket = np.maximum(bucket - 1, 0)  # the first head has all rows up to the second
        head = heads["k"].to_numpy(np.int64)[bucket] == k
        head[some] &= np.asarray(np.append(known[:1].repeat(none), known)[bucket[some]] == values, bool) & (bucket[some] >= none) if len(known) else False
        head[missing] &= bucket[missing] < none
        return bucket, head

    return place


def with_next(docs: DataFrame, run, schema: str, id_col: str, text_col: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Stream rows in (id, text key) order through run(text, next text), which gives a tuple of the schema; one shuffle of the texts.

    Spark range-partitions the ids and text keys alone; the first of each range is a head (one id per rows_per_bucket rows comes to the driver,
    fewer rows on small tables). Heads cut rows into buckets, one per task. A bucket's head also goes, as a sentinel, to the end of the bucket before,
    that of the first one to the last. So every task has the next row of all its own, and holds two texts at a time, however large a bucket
    is. Ids may be of any type that Spark orders and pandas compares alike (numbers, texts, dates, timestamps).
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("k"), text_of(text_col).alias("text"))
    names = [c.split()[0] for c in f"id x, {schema}".split(", ")]
    n = rows.count()
    if not n:
        return spark.createDataFrame([], f"id {kind.simpleString()}, {schema}")
    wanted = max(-(-n // rows_per_bucket), min(4 * partitions(spark), -(-n // 200)))
    ranges = rows.select("id", "k").repartitionByRange(wanted, F.asc_nulls_first("id"), "k").groupBy(F.spark_partition_id().alias("p"))
    # a null integer goes to Python as zero, with a mark: pandas would make floats of all
    filled = F.coalesce("id", F.lit(0).cast(kind)) if isinstance(kind, IntegralType) else F.col("id")
    heads = ranges.agg(F.min(F.struct("id", "k")).alias("head")).select("head.id", "head.k").orderBy(F.asc_nulls_first("id"), "k")
    heads = heads.select(filled.alias("id"), F.col("id").isNull().alias("none"), "k").toPandas()
    place, buckets = _placed(heads), len(heads)

    @F.pandas_udf("struct<bucket int, head boolean>")
    def dealt_to(ids: pd.Series, none: pd.Series, k: pd.Series) -> pd.DataFrame:
        bucket, head = place(ids, none.to_numpy(bool), k.to_numpy(np.int64))
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "head": head})

    at = F.col("at")
    copies = F.array(F.struct(at["bucket"].alias("bucket"), F.lit(False).alias("sentinel")), F.when(at["head"], F.struct(F.pmod(at["bucket"] - 1, F.lit(buckets)).cast("int").alias("bucket"), F.lit(True).alias("sentinel"))))
    dealt = rows.withColumn("at", dealt_to(filled, F.col("id").isNull(), "k")).withColumn("c", F.explode(F.array_compact(copies))).select("c.bucket", "c.sentinel", "id", "k", "text")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, over = None, False  # held: the row that waits for its next one
        for batch in batches:
            out = []
            for sentinel, doc, text in zip(batch["sentinel"], batch["id"], batch["text"], strict=True):
                if over:
                    break  # rows that agree with the next head in id and text come again
                if held is not None:
                    out.append((held[0], *run(held[1], text)))
                held, over = (doc, text), sentinel
            yield pd.DataFrame(out, columns=names)

    return in_batches(dealt.repartitionById(buckets, "bucket").sortWithinPartitions("sentinel", F.asc_nulls_first("id"), "k"), stream, schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 24, slots: int = 128) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text (second half replaced by the head of the next document's text),
    their likeness, the likeness to the next document's, and the longest common prefix with the edited text."""
    last: dict = {}

    def of(text: str) -> tuple[PrefixHashes, str]:
        if last.get("text") is not text and last.get("text") != text:
            h = PrefixHashes(text)
            last.update(text=text, got=(h, fingerprint(h, window, slots)))
        return last["got"]

    def run(text: str, after: str) -> tuple:
        h, own = of(text)
        half = h.n // 2
        edit = text[: h.n - half] + after[:half] if half else text
        g = PrefixHashes(edit)
        changed = fingerprint(g, window, slots)
        common = h.extension(0, g, 0)
        _, following = of(after)
        return h.n, hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed), likeness(own, following), common

    schema = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"
    return with_next(docs, run, schema, id_col, text_col).withColumnRenamed("id", id_col)
