"""LM scoring: interpolated modified Kneser-Ney bigrams, counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Counting: every task turns its texts into 64-bit word hashes and emits, for each few million tokens, its distinct bigrams with their
counts, packed as arrays and cut into shards by the bigram's hash. So a frequent pair is one entry per block, and a frequent word's
pairs spread over all shards. A shard's merge writes the sorted bigram hashes with their counts, and passes on, per word, what the shard
knows of it: its count, its continuation count, its count as a context and how many of its pairs occur once, twice or more often. A second
merge, by word, writes the sorted word hashes with these numbers. Only sums over all shards (a dozen numbers) come to the driver.

A shard is one file with all its arrays, made by one task. Scoring: every task looks up the distinct words and bigrams of a block in sorted order,
mapping the shards that have any one after the other, a bounded number at a time and without keeping their descriptors, and
adds up log10 probabilities per text. Work per block follows its distinct n-grams, not the number of shards.

P(w | h) = max(c(h w) - D(c), 0) / c(h) + g(h) P(w);  P(w) = max(N(. w) - D'(N), 0) / N(. .) + g' / (V + 1), V known words and one for all
others. Discounts are those of Chen and Goodman, from the counts of counts. A text starts after a start mark and ends with an end token.

The shared folder (spark.checkpoint.dir) must be one that workers can map: a POSIX mount. Files are written under a
temporary name and renamed, so repeated or concurrent attempts of a task leave the same file.

Defined cases: null text is empty and has the end token alone; without training rows all words are unknown and P = 1; repeated rows
count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, remove, scratch, text_of

#: Hashes of the start mark and the end token, which no word is likely to have.
BOS, EOS = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)
BLOCK = 1_500_000


class _Hashes(dict):
    """Word (bytes) -> 64-bit hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh64_intdigest(word, 7)
        return out


_WORDS = _Hashes()


def token_hashes(text: str) -> np.ndarray:
    """Hashes of the words (A-Z lower-cased, cut at ASCII white space) and of the end token."""
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out[-1] = EOS
    return out


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + (w ^ w >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _blocks(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[list[pd.DataFrame], list[np.ndarray]]]:
    """Rows and token hashes, a few million tokens at a time; a single text is never cut."""
    frames, tokens, n = [], [], 0
    for batch in batches:
        begin = 0
        for i, text in enumerate(batch[column]):
            tokens.append(token_hashes(text))
            n += len(tokens[-1])
            if n >= BLOCK:
                yield [*frames, batch.iloc[begin : i + 1]], tokens
                frames, tokens, n, begin = [], [], 0, i + 1
        frames.append(batch.iloc[begin:].drop(columns=column))
    if tokens:
        yield frames, tokens


def _pairs(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = np.concatenate(tokens)
    h = np.append(BOS, w[:-1])
    h[np.append(0, np.cumsum([len(t) for t in tokens])[:-1])] = BOS
    return h, w


def _small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds x."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{max(1, len(data) // max(1, n))}").astype(np.int64)


def _count(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, tokens in _blocks(batches):
            h, w = _pairs(tokens)
            key = pair_hash(h, w)
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            h, w, shard = h[first], w[first], (key[first] >> np.uint64(64 - bits) if bits else np.zeros(len(first), np.uint64))
            order = np.argsort(shard << np.uint64(64 - bits) | h >> np.uint64(bits) if bits else h)  # equal contexts side by side, for the shuffle's compression
            h, w, counts, shard = h[order], w[order], counts[order], shard[order]
            rows = [(int(s), h[i:j].tobytes(), w[i:j].tobytes(), _small(counts[i:j]).tobytes()) for s, i, j in _runs(shard)]
            yield pd.DataFrame(rows, columns=["shard", "h", "w", "c"])

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[np.generic, int, int]]:
    """(value, begin, end) of each run of equal neighbours."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, int)
    return zip(x[first], first.tolist(), np.append(first[1:], len(x)).tolist(), strict=True)


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the number of arrays, (length, bytes a number) of each, the arrays; each starts at a multiple of 8."""
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.array([len(arrays), *(x for a in arrays.values() for x in (len(a), a.itemsize))], np.int64).tobytes())
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(own, f"{folder}/{name}")


def _read(path: str, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; the map ends with its arrays, and no descriptor stays open."""
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    head = np.frombuffer(data, np.int64, 2 * len(names), 8).reshape(-1, 2).tolist()
    out, at = {}, 8 + 16 * len(names)
    for name, (n, size) in zip(names, head, strict=True):
        out[name] = np.frombuffer(data, f"u{size}", n, at)
        at += n * size + -(n * size) % 8
    return out


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in columns]


def _merge_pairs(folder: str, word_bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        h, w = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows[c]]) for c in "hw")
        c = np.concatenate([_wide(x, len(y) // 8) for x, y in zip(rows["c"], rows["h"], strict=True)])
        key = pair_hash(h, w)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, h, w, c = key[first], h[order[first]], w[order[first]], np.add.reduceat(c[order], first)
        big = np.flatnonzero(c >= 255)
        _write(folder, f"pairs-{shard:06d}", {"key": key, "count": np.minimum(c, 255).astype(np.uint8), "big_at": big, "big_count": c[big]})
        # per word: count, continuations, count as a context, pairs seen once, twice, more often
        one = np.ones(len(c), np.int64)
        as_w, a = _sums(w, [c, one])
        as_h, b = _sums(h, [c, (c == 1) * one, (c == 2) * one, (c > 2) * one])
        words, columns = _sums(np.concatenate([as_w, as_h]), [np.concatenate(x) for x in [*((v, np.zeros(len(as_h), np.int64)) for v in a), *((np.zeros(len(as_w), np.int64), v) for v in b)]])
        of = (words >> np.uint64(64 - word_bits)).astype(np.int64) if word_bits else np.zeros(len(words), np.int64)
        seen = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        out = []
        for s, i, j in _runs(of):
            out.append((int(s), words[i:j].tobytes(), *(_small(x[i:j]).tobytes() for x in columns), *([0] * 4 if out else seen)))
        return pd.DataFrame(out, columns=["word_shard", "words", *STATS, "n1", "n2", "n3", "n4"])

    return run


STATS = ["c", "cont", "ctx", "one", "two", "more"]
PAIR_ROWS = "word_shard int, words binary, " + ", ".join(f"{x} binary" for x in STATS) + ", n1 bigint, n2 bigint, n3 bigint, n4 bigint"
TOTALS = "m_more bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, tokens bigint, kinds bigint, pairs bigint, m1 bigint, m2 bigint, m3 bigint, m4 bigint"


def _merge_words(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["word_shard"].iloc[0])
        words = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["words"]])
        columns = [np.concatenate([_wide(x, len(y) // 8) for x, y in zip(rows[c], rows["words"], strict=True)]) for c in STATS]
        words, columns = _sums(words, columns)
        _write(folder, f"words-{shard:06d}", {"key": words, **{k: _small(v) for k, v in zip(STATS, columns, strict=True)}})
        c, cont = columns[:2]
        more = int((cont > 2).sum())
        met = [int((cont == k).sum()) for k in (1, 2, 3, 4)]
        seen = [int(rows[f"n{k}"].sum()) for k in (1, 2, 3, 4)]
        return pd.DataFrame([[more, *seen, int(c.sum()), int((c > 0).sum()), int(cont.sum()), *met]], columns=[x.split()[0] for x in TOTALS.split(", ")])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2, and 3 or more; where counts of counts are missing, the plain n1 / (n1 + 2 n2), at most the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    got = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y)
    return tuple(min(max(d, 0.0), float(k)) if d > 0 else min(y, float(k)) for k, d in zip((1, 2, 3), got, strict=True))


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    word_bits: int
    totals: dict

    def delete(self, spark: SparkSession) -> None:
        """Remove the model's files, when nothing is to be scored with it any more."""
        remove(spark, f"file://{self.folder}")

    @property
    def base_size(self) -> tuple[int, int]:
        """N, V"""
        return self.totals["tokens"], self.totals["kinds"]


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"workers can't map files in {path}; spark.checkpoint.dir must be a mounted folder")
    return path


def train(docs: DataFrame, text_col: str = "text", chars_per_shard: int = 12_000_000) -> Model:
    """Count all of docs' texts; the model stays in the shared folder until it is deleted."""
    rows = docs.select(text_of(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, chars / chars_per_shard))))
    word_bits = max(2, bits - 1)
    folder = _local(scratch(docs.sparkSession, "bigrams"))
    # one shard a task, so that what a task reads doesn't grow with the number of shards
    shards = rows.mapInPandas(_count(bits), "shard int, h binary, w binary, c binary").repartitionById(1 << bits, "shard").groupBy("shard").applyInPandas(_merge_pairs(folder, word_bits), PAIR_ROWS)
    sums = shards.repartitionById(1 << word_bits, "word_shard").groupBy("word_shard").applyInPandas(_merge_words(folder), TOTALS)
    totals = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns)).first().asDict()
    return Model(folder, bits, word_bits, totals)


class _Mapped:
    """The model's files, mapped when asked for; the `most` last used ones stay."""

    NAMES = {"pairs": ("key", "count", "big_at", "big_count"), "words": ("key", *STATS)}

    def __init__(self, model: Model, most: int = 32) -> None:
        self.model, self.most, self.files = model, most, OrderedDict()

    def shard(self, kind: str, number: int) -> dict[str, np.ndarray] | None:
        name = f"{kind}-{number:06d}"
        if name not in self.files:
            path = f"{self.model.folder}/{name}"
            self.files[name] = _read(path, self.NAMES[kind]) if os.path.exists(path) else None
            if len(self.files) > self.most:
                self.files.popitem(last=False)
        self.files.move_to_end(name)
        return self.files[name]

    def find(self, kind: str, bits: int, keys: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """keys are sorted; per shard: its arrays, where in keys, and where in the arrays the keys are that it has."""
        of = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
        for s, i, j in _runs(of):
            arrays = self.shard(kind, int(s))
            if arrays is None or not len(arrays["key"]):
                continue
            have = arrays["key"]
            at = np.minimum(np.searchsorted(have, keys[i:j]), len(have) - 1)
            hit = np.flatnonzero(have[at] == keys[i:j])
            yield arrays, hit + i, at[hit]

    def words(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        out = {c: np.zeros(len(keys), np.int64) for c in STATS}
        for arrays, to, at in self.find("words", self.model.word_bits, keys):
            for c in STATS:
                out[c][to] = arrays[c][at]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for arrays, to, at in self.find("pairs", self.model.bits, keys):
            got = arrays["count"][at].astype(np.int64)
            big = np.flatnonzero(got == 255)
            if len(big):
                got[big] = arrays["big_count"][np.searchsorted(arrays["big_at"], at[big])]
            out[to] = got
        return out


def _of(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _scored(mapped: _Mapped, tokens: list[np.ndarray]) -> dict[str, np.ndarray]:
    t = mapped.model.totals
    n, v, all_pairs = t["tokens"], t["kinds"], t["pairs"]
    d, e = discounts(t["n1"], t["n2"], t["n3"], t["n4"]), discounts(t["m1"], t["m2"], t["m3"], t["m4"])
    h, w = _pairs(tokens)
    words, inverse = np.unique(np.append(w, BOS), return_inverse=True)
    s = mapped.words(words)
    s["c"][words == BOS] = s["cont"][words == BOS] = 0
    at, start = inverse[:-1], inverse[-1]
    before = np.where(h == BOS, start, np.append(start, at[:-1]))
    if all_pairs:
        low = np.maximum(s["cont"] - _of(s["cont"], e), 0) / all_pairs + (e[0] * t["m1"] + e[1] * t["m2"] + e[2] * t["m_more"]) / all_pairs / (v + 1)
    else:
        low = np.full(len(words), 1.0 / (v + 1))
    ctx = np.maximum(s["ctx"], 1)
    back = np.where(s["ctx"] > 0, (d[0] * s["one"] + d[1] * s["two"] + d[2] * s["more"]) / ctx, 1.0)
    keys, which = np.unique(pair_hash(h, w), return_inverse=True)
    c = mapped.pairs(keys)[which]
    p = np.where(c > 0, np.maximum(c - _of(c, d), 0) / ctx[before], 0.0) + back[before] * low[at]
    first = np.append(0, np.cumsum([len(x) for x in tokens])[:-1])
    return {
        "n_tokens": np.array([len(x) for x in tokens], np.int64),
        "n_known": np.add.reduceat((s["c"] > 0)[at].astype(np.int64), first),
        "base_score": np.add.reduceat(np.log10((s["c"] + 1) / (n + v + 1))[at], first),
        "score": np.add.reduceat(np.log10(p), first),
    }


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability), perplexity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapped = _Mapped(model)
        for frames, tokens in _blocks(batches):
            ids = pd.concat([f[["id"]] for f in frames if len(f)], ignore_index=True)
            out = ids.assign(**_scored(mapped, tokens))
            yield out.assign(train_tokens=model.totals["tokens"], perplexity=10.0 ** (-out["score"] / out["n_tokens"]))[["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]]

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return in_batches(rows, run, "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)
