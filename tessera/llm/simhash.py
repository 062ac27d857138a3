"""SimHash near-dedup with anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Bits 0-30 and 31-61 are two segments; in each, the anchors are the
2^26 codewords of the perfect Hamming code (31, 26), whose covering radius is 1: every word has exactly one home anchor within one
bit. Two fingerprints that differ in at most 3 bits differ in at most 1 bit of one of the two segments; there, the home
anchor of either lies within 1 + 1 = 2 bits of the other. So each fingerprint is replicated to every anchor within 2 bits, of
which there are 16 at most (the closed form is in `anchors`), and compared, per anchor, with those at home there. No pair is missed.

Per anchor, a breadth-first walk emits a spanning forest of the links: never more rows than members, whatever the
number of pairs. Links are merged by `components`. Copies meet as one fingerprint, so groups of copies cost nothing.

An anchor with more than `LARGE` fingerprints is split: outside the anchor's segment, two linked ones differ in at most 3 of 33 bits, so of four blocks of these
bits one is the same in both. Each fingerprint of such an anchor goes to its four (anchor, block, value) and is compared there; again no pair is missed.

Defined cases: null text is empty; a text without words has fingerprint zero and links like any other; shorter texts are one
shingle; extra columns are ignored by `simhash_groups`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, text_of, thrifty, without
from .components import components

SEGMENT, LOW = 31, np.uint64((1 << 31) - 1)
#: Fingerprints of an anchor that one task compares; more are split.
LARGE = 4_096


def shingle_hashes(text: str, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` words, A-Z lower-cased, words joined by one space."""
    import xxhash

    data = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes: ASCII case and ASCII white space only
    if not data:
        return np.empty(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data)).tolist()
    width = min(width, len(ends))
    starts = [0, *(x + 1 for x in ends[: len(ends) - width])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[i:j], 42) for i, j in zip(starts, ends[width - 1 :], strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, piece: int = 1 << 16) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), piece):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[i : i + piece].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """31-bit words -> (index of the word, anchor, is it the home?) for all codewords within two bits.

    The syndrome is the XOR of the 1-based positions of set bits. A codeword has none within two bits but itself; else the
    home is one flip away, at position syndrome, and 15 pairs of positions have the syndrome as their XOR.
    """
    words = words.astype(np.uint64)
    syndrome = np.zeros(len(words), np.uint64)
    one = np.uint64(1)
    for i in range(SEGMENT):
        syndrome ^= (words >> np.uint64(i) & one) * np.uint64(i + 1)
    at = np.arange(len(words))
    flip = lambda w, p: np.where(p > 0, w ^ (one << (np.maximum(p, one) - one)), w)
    index, codes, home = [at], [flip(words, syndrome)], [np.ones(len(words), bool)]
    for i in range(1, SEGMENT + 1):
        other = syndrome ^ np.uint64(i)
        use = (syndrome > 0) & (other > np.uint64(i))
        index.append(at[use])
        codes.append(flip(flip(words[use], np.full(use.sum(), i, np.uint64)), other[use]))
        home.append(np.zeros(int(use.sum()), bool))
    return np.concatenate(index), np.concatenate(codes), np.concatenate(home)


def _replicated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for segment in (0, 1):
            index, codes, home = anchors(prints >> np.uint64(SEGMENT * segment) & LOW)
            key = codes | np.uint64(segment << SEGMENT)
            yield pd.DataFrame({"anchor": key.view(np.int64), "guest": ~home, "fp": prints[index].view(np.int64)})


def _forest(prints: np.ndarray, homes: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links (at most `most` bits) that involve one of the first `homes` prints."""
    found, left, queue = [], np.arange(len(prints)), []
    while True:
        if not queue:
            if not len(left) or left[0] >= homes:
                return found
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        pool = left if node < homes else left[: np.searchsorted(left, homes)]
        near = pool[np.bitwise_count(prints[pool] ^ prints[node]) <= most]
        if len(near):
            found.append((np.full(len(near), node), near))
            queue.extend(near.tolist())
            left = np.setdiff1d(left, near, assume_unique=True)


LINKED = "a bigint, b bigint, kind int"


def _linked(most: int, large: int | None):
    """Rows sorted by anchor, those at home first -> links (a, b, 0). Groups over `large` come out as they are: fp, anchor, 1 for home or 2."""

    def as_links(x: list, y: list) -> Iterator[pd.DataFrame]:
        if x:
            a, b = np.concatenate(x).view(np.int64), np.concatenate(y).view(np.int64)
            for i in range(0, len(a), 1 << 18):
                yield pd.DataFrame({"a": a[i : i + (1 << 18)], "b": b[i : i + (1 << 18)], "kind": np.int32(0)})

    def as_they_are(anchor: np.ndarray, guest: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": prints.view(np.int64), "b": anchor, "kind": 1 + guest.astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A group that a batch cuts off is carried to the next, up to `large` rows."""
        rest, ended, source, over = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.uint64)), False, iter(batches), None
        while not ended:
            batch = next(source, None)
            ended = batch is None
            new = rest if ended else tuple(np.concatenate(x) for x in zip(rest, (batch["anchor"].to_numpy(np.int64), batch["guest"].to_numpy(bool), batch["fp"].to_numpy(np.int64).view(np.uint64)), strict=True))
            if over is not None and len(new[0]):  # the rest of a group that is too large already
                k = int(np.searchsorted(new[0], over, "right"))
                if k:
                    yield as_they_are(*(x[:k] for x in new))
                new = tuple(x[k:] for x in new)
                over = over if not len(new[0]) else None
            anchor, guest, prints = rest = new
            if not len(anchor):
                continue
            stop = len(anchor) if ended else int(np.searchsorted(anchor, anchor[-1]))
            rest = (anchor[stop:], guest[stop:], prints[stop:])
            if large is not None and len(rest[0]) > large:
                over = rest[0][0]
                yield as_they_are(*rest)
                rest = tuple(x[:0] for x in rest)
            anchor, guest, prints = anchor[:stop], guest[:stop], prints[:stop]
            first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if stop else np.empty(0, int)
            size = np.diff(np.append(first, stop))
            a, b = [], []
            # small groups: each row against the k-th next one of the same anchor, all groups at once
            small = np.repeat(size <= 8, size)
            for k in range(1, min(8, stop)):
                together = anchor[k:] == anchor[:-k]
                if not together.any():
                    break
                use = np.flatnonzero(small[k:] & together & ~guest[:-k])
                use = use[np.bitwise_count(prints[use] ^ prints[use + k]) <= most]
                a.append(prints[use])
                b.append(prints[use + k])
            for at, n in zip(first[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                group = slice(at, at + n)
                if large is not None and n > large:
                    yield as_they_are(anchor[group], guest[group], prints[group])
                    continue
                for i, j in _forest(prints[group], int((~guest[group]).sum()), most):
                    a.append(prints[group][i])
                    b.append(prints[group][j])
            yield from as_links(a, b)

    return run


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of large anchors, each at four keys: the anchor, and one of four blocks of the bits outside its segment."""
    for batch in batches:
        prints, anchor = batch["a"].to_numpy(np.int64).view(np.uint64), batch["b"].to_numpy(np.int64)
        second = anchor.view(np.uint64) >> np.uint64(SEGMENT) & np.uint64(1) > 0
        # bits 31-63 for the first segment's anchors, bits 62-63 and 0-30 for the second's
        outside = np.where(second, prints & LOW | (prints >> np.uint64(62)) << np.uint64(31), prints >> np.uint64(31))
        for i in range(4):
            value = outside >> np.uint64(8 * i) & np.uint64(0x1FF if i == 3 else 0xFF)
            key = anchor.view(np.uint64) ^ (value | np.uint64(i) << np.uint64(9)) << np.uint64(33)
            yield pd.DataFrame({"anchor": key.view(np.int64), "guest": batch["kind"] == 2, "fp": batch["a"]})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_key, fp bigint): text_key is a 64-bit hash of the text, to find a row again among others of the same id."""
    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prints = np.fromiter((fingerprint(shingle_hashes(t.as_py(), width)) for t in part["text"]), np.uint64, part.num_rows)
        yield pa.RecordBatch.from_arrays([part["id"], part["text_key"], pa.array(prints.view(np.int64))], ["id", "text_key", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    return in_slices(rows, each, f"id {rows.schema['id'].dataType.simpleString()}, text_key bigint, fp bigint")


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Distinct fp -> links (a, b) whose components are those of all pairs at `most` bits or fewer. most: 0 to 3."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with a covering radius of 1 hold for thresholds up to 3")
    dealt = prints.select("fp").distinct().mapInPandas(_replicated, "anchor bigint, guest boolean, fp bigint")
    met = cut(dealt.repartition("anchor").sortWithinPartitions("anchor", "guest", "fp").mapInPandas(thrifty(_linked(most, LARGE)), LINKED))
    again = met.where("kind > 0").mapInPandas(_split, "anchor bigint, guest boolean, fp bigint")
    more = again.repartition("anchor").sortWithinPartitions("anchor", "guest", "fp").mapInPandas(thrifty(_linked(most, None)), LINKED)
    return met.where("kind = 0").unionByName(more).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """(id, text_key, fp, component_id, rep_key): component_id is the smallest id reachable by links, rep_key the smallest text_key of its rows."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("least")))
    roots = cut(components(links(distinct, most)))
    of = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = of.groupBy("root").agg(F.min("least").alias("best"))
    of = of.join(best, "root").select("fp", F.col("best.id").alias("component_id"), F.col("best.text_key").alias("rep_key"))
    return rows.join(of, "fp").select(F.col("id").alias(id_col), "text_key", "fp", "component_id", "rep_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest id (and text_key, where rows share the id). All columns stay as they are."""
    return keep_first(docs, simhash_groups(docs, id_col, text_col, width, most), id_col, text_col)


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the row of each component that groups (id, text_key, component_id, rep_key) names."""
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("rep_key"))
    marks = groups.groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("key")).agg(F.max(stays).alias("once"), F.count("*").alias("_n"))
    return without(docs, marks.where("NOT once OR _n > 1").select("id", "key", "once"), id_col, F.xxhash64(text_of(text_col)), docs.columns)
