"""Hard-negative mining with bit-sliced integer inner products.

Vectors become integers (floor(scale * x)). A row's score with an anchor a is the sum over bit-planes b of 2^b * (a . bits_b of the row); planes are processed
from the most significant one. After each, the score lies in an interval: what is summed so far, plus (2^b - 1) times the sum of a's negative
components at least and that of its positive ones at most. A pair of row and anchor is dropped once its interval can't qualify any more: it lies below the k-th best lower bound
(or the k-th best score of earlier batches), or outside the band of scores that is asked for. The first planes are matrix products; once few pairs are left, the remaining planes are
summed for these pairs alone. All that survives has its exact score, so the result is exact.

On Spark: all anchors are compared with all rows, in blocks. Anchors are cut into blocks of `anchors_per_block`, rows into groups by a hash of their id; a cell (block, group) is one run of a sorted
partition, its anchors first. So a task holds one block and one batch of rows, nothing is broadcast, and no vector goes through the driver; each cell returns the k best rows of an anchor, and
a window over these few takes the k best of all. First the positives (the best rows of the anchor's label), then the negatives in each positive's band.

Defined cases: rows with a null label, vector or component, a component that isn't finite, or no components take no part; neither do rows with a null id, which can't be named, nor rows with a component so large
that a score may not fit in a long (see `largest`). A shorter vector counts as if it ended in zeros. Rows that agree in id, label and vector count once; rows that share an id otherwise are
rows of their own, but never an anchor's positive or negative if the id is the anchor's. Ties go to the smaller id. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Anchors that a task compares at a time, with rows of so many components together; pairs of an anchor and a row whose planes are summed at a time.
CHUNK, ELEMENTS, PAIRS = 128, 1 << 20, 1 << 16
#: Once fewer than this share of pairs is left, planes are summed for these alone.
SPARSE = 1 / 24


def largest(dim: int) -> int:
    """The largest magnitude of an integer component with which no score of `dim` components leaves 63 bits."""
    return (1 << (63 - max(1, dim - 1).bit_length()) // 2) - 1


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0, label: Column | None = None) -> DataFrame:
    """(id long, label long, vec array<int>) of the rows that take part; labels that aren't integers are hashed."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.col("_label").isNotNull() & F.col("_id").isNotNull() & (F.size("_vec") > 0)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    limit = F.expr("shiftleft(1L, cast((63 - length(bin(greatest(size(_vec) - 1, 1)))) div 2 AS int)) - 1")
    rows = vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("_id"), (F.col(label_col) if label is None else label).alias("_label"), parts.alias("_vec"))
    kind = rows.schema["_label"].dataType
    fits = F.forall("_vec", lambda x: F.abs(x) <= F.least(limit, F.lit((1 << 31) - 1)))
    named = F.col("_label").cast("long") if kind.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("_label")
    return rows.where(usable & fits).select(F.col("_id").alias("id"), named.alias("label"), F.col("_vec").cast("array<int>").alias("vec"))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Lists -> one int64 matrix, shorter ones padded with zeros."""
    sizes = vectors.map(len).to_numpy()
    out = np.zeros((len(vectors), int(sizes.max(initial=0))), np.int64)
    if len(vectors):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(vectors.to_numpy())
    return out


def padded(m: np.ndarray, dim: int) -> np.ndarray:
    return m if m.shape[1] == dim else np.pad(m, ((0, 0), (0, dim - m.shape[1])))


def kth_best(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Per column, the k-th largest of the allowed values; the smallest integer if there are fewer."""
    none = np.iinfo(np.int64).min
    if len(values) < k:
        return np.full(values.shape[1], none)
    return np.partition(np.where(allowed, values, none), len(values) - k, axis=0)[len(values) - k]


def survivors(rows: np.ndarray, anchors: np.ndarray, allowed: np.ndarray, needed: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], floor: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row index, anchor index, exact score) of the pairs that are left after all planes.

    allowed: pairs (row, anchor) to look at. needed(low, high, anchor index) tells which intervals may still qualify; floor(low, high, allowed) tightens what
    is needed from the intervals of all pairs while planes are matrix products.
    """
    top = int(max(rows.max(initial=0), -1 - rows.min(initial=0))).bit_length()
    # as unsigned numbers of top + 1 bits: the offset's share of the score is known from the start
    shifted = rows + (1 << top)
    weights = anchors.T.astype(np.float64)
    below, above = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
    partial = np.broadcast_to(-(anchors.sum(1) << top), (len(rows), len(anchors))).copy()
    alive, plane = allowed.copy(), top
    every = np.arange(len(anchors))
    while plane >= 0:
        partial += (((shifted >> plane) & 1).astype(np.float64) @ weights).astype(np.int64) << plane
        rest = (1 << plane) - 1
        low, high = partial + rest * below, partial + rest * above
        floor(low, high, alive)
        alive &= needed(low, high, every)
        plane -= 1
        if np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    at, of = np.nonzero(alive)
    scores = partial[at, of]
    while plane >= 0 and len(at):
        for i in range(0, len(at), PAIRS):
            piece = slice(i, i + PAIRS)
            scores[piece] += np.einsum("ij,ij->i", (shifted[at[piece]] >> plane) & 1, anchors[of[piece]]) << plane
        rest = (1 << plane) - 1
        keep = needed(scores + rest * below[of], scores + rest * above[of], of)
        at, of, scores = at[keep], of[keep], scores[keep]
        plane -= 1
    return at, of, scores


class Best:
    """The k best (score, id) of each key so far; keys are (anchor, band)."""

    def __init__(self, keys: int, k: int):
        self.k, self.kept = k, (np.empty(0, np.int64),) * 3
        self.least = np.full(keys, np.iinfo(np.int64).min)

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        key, score, ident = (np.concatenate(x) for x in zip(self.kept, (key, score, ident), strict=True))
        order = np.lexsort((ident, -score, key))
        key, score, ident = key[order], score[order], ident[order]
        first = np.searchsorted(key, key)
        nth = np.arange(len(key)) - first
        last = nth == self.k - 1
        self.least[key[last]] = score[last]
        self.kept = tuple(x[nth < self.k] for x in (key, score, ident))


FOUND = "anchor_id long, band int, other_id long, score long"


def _cells(k: int, bands: int, low: int, high: int, whole: int):
    """Sorted rows of cells (anchors first) -> FOUND. bands 0: the k best of the anchor's label; else the k best of other labels in the band of each positive."""

    def blocks(frame: pd.DataFrame) -> list[tuple]:
        """One cell's anchors -> chunks with their state."""
        out = []
        for i in range(0, len(frame), CHUNK):
            part = frame.iloc[i : i + CHUNK]
            n = len(part)
            if bands:
                floor, ceil = np.full((n, bands), 1, np.int64), np.zeros((n, bands), np.int64)  # empty bands
                for j, pos in enumerate(part["pos"]):
                    for b, p in enumerate(() if pos is None else pos):
                        s = int(p["score"])
                        floor[j, b], ceil[j, b] = -(-low * s // whole), high * s // whole
            else:
                floor, ceil = np.full((n, 1), np.iinfo(np.int64).min), np.full((n, 1), np.iinfo(np.int64).max)
            out.append((part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64), matrix(part["vec"]), floor, ceil, Best(n * floor.shape[1], k)))
        return out

    def compare(chunk: tuple, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        own, kinds, anchors, floor, ceil, best = chunk
        dim, wide = max(rows.shape[1], anchors.shape[1]), floor.shape[1]
        rows, anchors = padded(rows, dim), padded(anchors, dim)
        allowed = (ids[:, None] != own) & ((labels[:, None] == kinds) ^ bool(bands))
        least = np.maximum(floor, best.least.reshape(floor.shape))  # what a score must reach, by anchor and band

        def tighten(lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> None:
            for b in range(wide):
                inside = alive & (lo >= floor[:, b]) & (hi <= ceil[:, b])
                least[:, b] = np.maximum(least[:, b], kth_best(lo, inside, k))

        def needed(lo: np.ndarray, hi: np.ndarray, of: np.ndarray) -> np.ndarray:
            out = np.zeros(lo.shape, bool)
            for b in range(wide):
                out |= (hi >= least[of, b]) & (lo <= ceil[of, b])
            return out

        at, of, scores = survivors(rows, anchors, allowed, needed, tighten)
        for b in range(wide):
            use = (scores >= least[of, b]) & (scores <= ceil[of, b])
            if use.any():
                best.add(of[use] * wide + b, scores[use], ids[at[use]])

    def results(chunks: list[tuple]) -> Iterator[pd.DataFrame]:
        for own, _, _, floor, _, best in chunks:
            key, score, ident = best.kept
            if len(key):
                yield pd.DataFrame({"anchor_id": own[key // floor.shape[1]], "band": (key % floor.shape[1]).astype(np.int32), "other_id": ident, "score": score})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, heads, chunks, last = None, [], [], None
        for batch in batches:
            for (block, bucket), frame in batch.groupby(["block", "bucket"], sort=False):
                if (block, bucket) != cell:
                    yield from results(chunks)
                    cell, heads, chunks, last = (block, bucket), [], [], None
                is_head = frame["anchor"].to_numpy(bool)
                if is_head.any():
                    heads.append(frame[is_head])
                frame = frame[~is_head]
                if not len(frame):
                    continue
                if heads:
                    chunks, heads = blocks(pd.concat(heads)), []
                # rows that agree in all three are neighbours
                ids, labels, rows = frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), matrix(frame["vec"])
                same = np.zeros(len(ids), bool)
                same[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (rows[1:] == rows[:-1]).all(1)
                if last is not None and len(ids) and last[0] == ids[0] and last[1] == labels[0]:
                    dim = max(rows.shape[1], len(last[2]))
                    same[0] = (np.pad(rows[0], (0, dim - rows.shape[1])) == np.pad(last[2], (0, dim - len(last[2])))).all()
                last = (ids[-1], labels[-1], rows[-1])
                ids, labels, rows = ids[~same], labels[~same], rows[~same]
                step = max(256, ELEMENTS // max(1, rows.shape[1]))
                for i in range(0, len(ids), step):
                    for chunk in chunks:
                        compare(chunk, ids[i : i + step], labels[i : i + step], rows[i : i + step])
        yield from results(chunks)

    return run


def _compared(rows: DataFrame, anchors: DataFrame, blocks: int, buckets: int, k: int, bands: int, low: int, high: int, whole: int) -> DataFrame:
    """Every anchor against every row, by cells -> the k best per anchor and band, ranked."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    heads = anchors.select("block", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("anchor"), "id", "label", "vec", "pos")
    others = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), bucket.alias("bucket"), F.lit(False).alias("anchor"), "id", "label", "vec", F.lit(None).cast("array<struct<id:long,score:long>>").alias("pos"))
    cells = heads.unionByName(others).repartition(max(partitions(rows.sparkSession), min(blocks * buckets, 1 << 16)), "block", "bucket").sortWithinPartitions("block", "bucket", F.desc("anchor"), "id", "label", "vec")
    found = cells.mapInPandas(_cells(k, bands, low, high, whole), FOUND)
    best = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256.0, label: Column | None = None, anchors_per_block: int = 4_096, rows_per_bucket: int = 65_536,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor: condition over the column id. label: what counts as the label, over the columns of vectors. Per anchor and positive, the best `negatives` rows of other
    labels whose score s satisfies low * positive <= whole * s <= high * positive.
    """
    rows = cut(integers(vectors, id_col, vector_col, label_col, scale, label))
    marked = rows.where(is_anchor).dropDuplicates(["id", "label", "vec"])
    n_rows, n_anchors = rows.count(), rows.where(is_anchor).count()
    blocks, buckets = max(1, -(-n_anchors // anchors_per_block)), max(1, -(-n_rows // rows_per_bucket), min(partitions(vectors.sparkSession), n_rows // 1_000))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("pos")
    marked = cut(marked.select(block, "id", "label", "vec", none))
    best = _compared(rows, marked, blocks, buckets, positives, 0, low, high, whole)
    mates = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other_id").alias("id"), "score"))).alias("mates"))
    mates = cut(mates.select("anchor_id", F.transform("mates", lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("pos")))
    ready = marked.drop("pos").join(mates, marked["id"] == mates["anchor_id"]).select("block", "id", "label", "vec", "pos")
    found = _compared(rows, ready, blocks, buckets, negatives, positives, low, high, whole)
    named = found.join(mates, "anchor_id").withColumn("positive", F.get("pos", "band"))
    return named.select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score")
    )
