"""Near-dedup by SimHash anchors and exact Jaccard similarity of word shingles, without missed links.

Two sets of distinct shingle hashes are linked if their Jaccard similarity is at least 4/5. Links are looked for in two steps:

1. Candidates at linear cost. The fingerprints of the same shingles go through the anchor covering of `simhash` (3 bits or fewer), and documents that agree
   in a band of minimum hashes are compared with one head of that band: the one with the smallest share of shingles that few documents have, so in
   a large group of near copies the one closest to what they have in common. What is confirmed on the texts is merged.
2. The rest, exactly: prefix filtering over documents of different components. In one order of all shingles, two linked sets share a shingle
   among the first n // 5 + 1 of either. Shingles that a sample of documents has often rank last in that order. Two documents that meet only on
   such common shingles have at most the common ones together, which rules out most pairs before they are made; the remaining ones are
   counted per pair, and those that could still reach 4/5 are confirmed on the texts. Any sample gives the same links.

Defined cases: null text is empty; texts of equal shingle sets are linked, also those without words; shorter texts are one shingle; a null id ranks after all others; rows that
agree in id and text are one document, of which `drop_alike` keeps one row; extra columns are ignored, and stay as they are in `drop_alike`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, sized, text_of, thrifty
from .components import components
from .simhash import fingerprint, keep_first, links as anchor_links, shingle_hashes

# Documents sampled for common shingles, how often one of these counts as common, how many are kept at most.
SAMPLE, COMMON, MOST_COMMON = 20_000, 20, 1 << 18
# Minimum hashes, how many make a band, how many must agree before a text comparison.
MINIMA, BAND, AGREE = 16, 2, 9
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, MINIMA, np.uint64) | np.uint64(1)


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def prefix(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first n // 5 + 1 of a sorted set in the order (is it common?, hash), and how many of the whole set are not common."""
    n = len(hashes) // 5 + 1
    if not len(common):
        return hashes[:n], len(hashes)
    late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    return np.concatenate((hashes[~late][:n], hashes[late]))[: min(n, len(hashes))], int((~late).sum())


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard similarity of two sorted sets 4/5 or more?"""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _common(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shingle_set(text.as_py(), width) for text in part["text"]]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["h"])

    share = min(1.0, SAMPLE / max(1, docs.count()))
    few = docs.select(text_of(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    counts = in_slices(few, each, "h bigint").groupBy("h").count().where(F.col("count") >= COMMON)
    return np.sort(counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


DESCRIBED = "text_key bigint, node bigint, n int, rare int, fp bigint, prefix array<bigint>, least array<bigint>"


def _described(width: int, common: np.ndarray):
    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        node, n, rare, prints, first, least = [], [], [], [], [], []
        for text in part["text"]:
            hashes = shingle_hashes(text.as_py(), width)
            s = np.unique(hashes)
            node.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))
            n.append(len(s))
            ahead, few = prefix(s, common)
            rare.append(few)
            prints.append(fingerprint(hashes))
            first.append(ahead.view(np.int64))
            least.append(np.array([(s * m).min() >> np.uint64(32) if len(s) else 0 for m in _ODD], np.uint64).view(np.int64))
        lists = pa.list_(pa.int64())
        columns = [part["id"], part["text_key"], np.array(node, np.int64), np.array(n, np.int32), np.array(rare, np.int32), np.array(prints, np.uint64).view(np.int64), pa.array(first, lists), pa.array(least, lists)]
        yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["id", "text_key", *(x.split()[0] for x in DESCRIBED.split(", ")[1:])])

    return each


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (h, n) -> pairs of different roots whose sizes allow 4/5; a group that a batch cuts off is carried to the next.

    A pair can have in common at most all shingles of either, or, where it meets on a common one, the common ones of either. (A pair that also shares
    a rare shingle in its prefixes meets there too.)
    """
    names = ("h", "n", "few", "node", "root")
    rest, source, ended = [np.empty(0, np.int64)] * len(names), iter(batches), False
    while not ended:
        batch = next(source, None)
        ended = batch is None
        new = rest if ended else [np.concatenate((x, batch[c].to_numpy(np.int64))) for x, c in zip(rest, names, strict=True)]
        if not len(new[0]):
            continue
        stop = len(new[0]) if ended else int(np.searchsorted(new[0], new[0][-1]))
        rest = [x[stop:] for x in new]
        h, n, few, node, root = (x[:stop] for x in new)
        rare, root = np.where(few < 0, -1 - few, few), np.where(root == 0, node, root)
        most = np.where(few < 0, n - rare, n)
        # groups of one root have no pairs; in the others, each row goes against the k-th next one
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if stop else np.empty(0, int)
        size = np.diff(np.append(first, stop))
        mixed = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), size) if stop else np.empty(0, bool)
        h, n, most, rare, node, root = (x[mixed] for x in (h, n, most, rare, node, root))
        at, k = np.arange(len(h)), 1
        while len(at):
            at = at[at + k < len(h)]
            at = at[(h[at] == h[at + k]) & (5 * n[at] >= 4 * n[at + k])]
            use = at[(root[at] != root[at + k]) & (9 * np.minimum(most[at], most[at + k]) >= 4 * (n[at] + n[at + k]))]
            if len(use):
                swap = node[use] > node[use + k]
                a, b = np.where(swap, use + k, use), np.where(swap, use, use + k)
                yield pd.DataFrame({"a": node[a], "b": node[b], "na": n[a], "nb": n[b], "ra": rare[a], "rb": rare[b]})
            k += 1


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) of nodes whose texts are alike."""

    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets: dict = {}
        good = []
        for a, b, x, y in zip(*(part[c] for c in "abxy"), strict=True):
            for node, text in ((a.as_py(), x), (b.as_py(), y)):
                if node not in sets:
                    sets[node] = shingle_set(text.as_py(), width)
            good.append(alike(sets[a.as_py()], sets[b.as_py()]))
        yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    some = texts.join(used, "node", "left_semi")
    both = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return in_slices(both.select("a", "b", "x", "y"), each, "a bigint, b bigint")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, text_key, component_id, rep_key): component_id is the smallest id reachable by links of similarity 4/5 or more, rep_key the smallest text_key of its rows."""
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    rows = cut(in_slices(keyed, _described(width, _common(docs, width, text_col)), f"id {keyed.schema['id'].dataType.simpleString()}, {DESCRIBED}"))
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("best"), *(F.first(c).alias(c) for c in ("n", "rare", "fp"))))
    held = nodes.select("node", F.col("best.id").alias("_id"), F.col("best.text_key").alias("_key"))

    def texts(pairs: DataFrame) -> DataFrame:
        used = sized(held.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
        found = keyed.join(used, keyed["id"].eqNullSafe(used["_id"]) & (keyed["text_key"] == used["_key"]))
        return found.groupBy("node").agg(F.first("text").alias("text"))

    # fingerprints within 3 bits: sets of one fingerprint go with its least one, then from fingerprint to fingerprint
    of_print = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first"))
    same_print = nodes.where("n > 0").join(of_print, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = anchor_links(of_print)
    near = near.join(of_print.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # large groups: each row against the head of each of its bands
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.col("least")[i].alias("u"), F.col("least")[i + 1].alias("v")) for i in range(0, MINIMA, BAND)))
    dealt = rows.where("n > 0").select("node", "least", (F.col("rare") / F.col("n")).alias("share"), F.explode(bands).alias("band"))
    heads = dealt.groupBy("band").agg(F.min(F.struct("share", "node", "least")).alias("head"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("band", "head")
    same = F.aggregate(F.zip_with("least", "head.least", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    stars = dealt.join(heads, "band").where((F.col("node") != F.col("head.node")) & (same >= AGREE)).select(F.col("node").alias("a"), F.col("head.node").alias("b"))
    first = stars.union(same_print).union(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = cut(first)
    links = cut(_confirmed(first, texts(first), width))
    roots = cut(components(links))

    # then every pair of different components
    # (one row of each set; root 0 stands for the node itself, few is the number of rare shingles, as -1 - few on rows of a common one)
    own = nodes.select("node", F.col("best.id").alias("_id"), F.col("best.text_key").alias("_key")).join(roots, "node", "left").select(F.col("node").alias("_node"), "_id", "_key", F.coalesce("root", F.lit(0)).alias("root"))
    known = rows.where("n > 0").join(own, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["node"])
    known = known.select("node", "n", "rare", "root", F.posexplode("prefix").alias("at", "h"))
    known = known.select("h", "n", F.when(F.col("at") < F.col("rare"), F.col("rare")).otherwise(-1 - F.col("rare")).alias("few"), "node", "root")
    met = known.repartition("h").sortWithinPartitions("h", "n").mapInPandas(thrifty(_pairs), "a bigint, b bigint, na bigint, nb bigint, ra bigint, rb bigint")
    met = met.groupBy("a", "b", "na", "nb", "ra", "rb").count()
    ahead = "({0} div 5 + 1)"
    # pairs that were not made on common shingles may have all those of their prefixes in common
    whole = "9 * least(na - ra, nb - rb) >= 4 * (na + nb)"
    unseen = f"greatest(least({ahead.format('na')} - ra, {ahead.format('nb')} - rb), 0)"
    shared = f"count + CASE WHEN {whole} THEN 0 ELSE {unseen} END"
    pairs = cut(met.where(F.expr(f"9 * ({shared} + greatest(na - {ahead.format('na')}, nb - {ahead.format('nb')})) >= 4 * (na + nb)")).select("a", "b"))
    links = links.union(_confirmed(pairs, texts(pairs), width))
    roots = cut(components(links))

    of = nodes.join(roots, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    best = of.groupBy("root").agg(F.min("best").alias("least"))
    of = of.join(best, "root").select("node", F.col("least.id").alias("component_id"), F.col("least.text_key").alias("rep_key"))
    return rows.select("id", "text_key", "node").join(of, "node").select(F.col("id").alias(id_col), "text_key", "component_id", "rep_key")


def drop_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """docs with one row of each component: that of the smallest id. All columns stay as they are."""
    return keep_first(docs, jaccard_groups(docs, id_col, text_col, width), id_col, text_col)
