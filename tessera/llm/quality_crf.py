"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own and of the lines before and after it; the chain labels each line good or bad. The forward-backward
marginals, weighted by line length, add up to the document's score. Labels are known for documents only, so in training each
line of a labelled document carries the document's label.

Training uses a bounded sample: the `sample` labelled rows with the smallest hashed ids (default 3,000), which are
found among the labels alone and then met in one pass over the documents, and of these the first ones that together have `sample_chars` characters
(default 16 million) at most; a text of over a 16th of that is left out. The chain is fitted in one task, so the driver gets no texts. Scoring runs in every task with a few hundred numbers.

Defined cases: null text is empty; a text without characters is one empty line and gets a score as any other; the last of an empty
line after a final line break counts as a line of weight 1; extra columns are ignored; without usable labels of both kinds, fitting
raises ValueError; of labels that disagree for an id the larger counts; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, in_slices, text_of, thrifty

#: Byte classes: lower, upper, digit, space, sentence marks, other marks, beyond ASCII, line break or control.
CLASSES = 8
_KIND = np.full(256, 5, np.uint8)
for _c in range(256):
    if 97 <= _c <= 122:
        _KIND[_c] = 0
    elif 65 <= _c <= 90:
        _KIND[_c] = 1
    elif 48 <= _c <= 57:
        _KIND[_c] = 2
    elif _c == 32:
        _KIND[_c] = 3
    elif chr(_c) in ".,;:?'\"()-":
        _KIND[_c] = 4
    elif _c >= 128:
        _KIND[_c] = 6
    elif _c < 32:
        _KIND[_c] = 7
OWN = 17


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line [lines, 3 * OWN + 1], line lengths, lines per text)."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    kind = _KIND[data]
    edges = np.append(starts, len(data))
    count = lambda hit: np.diff(np.append(0, np.cumsum(hit, dtype=np.int64))[edges])
    n = (ends - starts).astype(np.float64)
    some = np.maximum(n, 1)
    tally = [count(kind == k) for k in range(CLASSES - 1)]
    later = np.append(kind[1:], np.uint8(7))
    word_end = count((kind != 3) & (kind != 7) & ((later == 3) | (later == 7)))
    words = np.maximum(word_end, 1)
    same = np.append(data[1:], np.uint8(0)) == data
    x = np.empty((len(n), OWN))
    for k in range(CLASSES - 1):
        x[:, k] = tally[k] / some
    x[:, 7] = np.log1p(n) / 8
    x[:, 8] = n / words / 20
    x[:, 9] = count((kind == 5) & (later == 5)) / words  # marks in a row
    x[:, 10] = count((kind == 5) & ((later == 3) | (later == 7))) / words  # words that end in a mark
    x[:, 11] = count((kind == 1) & (later == 1)) / some  # runs of capitals
    x[:, 12] = count(same & (kind == 0)) / some
    x[:, 13] = count((kind == 4) & (later == 3)) / words
    x[:, 14] = count((kind == 0) & (later == 1)) / words
    x[:, 15] = n == 0
    split = [line.split(" ") for t in texts for line in t.split("\n")]
    x[:, 16] = [len(set(w)) / len(w) for w in split]  # how many of the words differ
    first = np.append(0, np.cumsum(per_text)[:-1])
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[first + per_text - 1] = 0, 0
    return np.hstack([x, before, after, np.ones((len(x), 1))]), np.maximum(n, 1), per_text


@dataclass
class Chain:
    """w: weights of the label 'good' by feature; pull: 2 x 2 transition weights; mean and scale standardise the features."""

    w: np.ndarray
    pull: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w


def marginals(good: np.ndarray, pull: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward for all chains at once. good: score of label 1 per line (label 0: zero).

    Returns P(label 1) per line, summed pair marginals [2, 2], log partition per text. Chains step together, the longest first.
    """
    order = np.argsort(-per_text, kind="stable")
    first = np.append(0, np.cumsum(per_text)[:-1])[order]
    length = per_text[order]
    longest = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]  # chains longer than t
    a = np.zeros((len(good), 2))
    for t in range(longest):
        at = first[: alive[t]] + t
        a[at, 1] = good[at]
        if t:
            was = a[at - 1]
            a[at, 0] += np.logaddexp(was[:, 0] + pull[0, 0], was[:, 1] + pull[1, 0])
            a[at, 1] += np.logaddexp(was[:, 0] + pull[0, 1], was[:, 1] + pull[1, 1])
    last = a[first + length - 1]
    log_z = np.logaddexp(last[:, 0], last[:, 1])
    b, pairs = np.zeros((len(good), 2)), np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        k = alive[t + 1]
        at = first[:k] + t
        nxt = b[at + 1] + np.stack([np.zeros(k), good[at + 1]], axis=1)
        joint = a[at][:, :, None] + pull[None] + nxt[:, None, :] - log_z[:k, None, None]
        pairs += np.exp(joint).sum(axis=0)
        b[at, 0] = np.logaddexp(nxt[:, 0] + pull[0, 0], nxt[:, 1] + pull[0, 1])
        b[at, 1] = np.logaddexp(nxt[:, 0] + pull[1, 0], nxt[:, 1] + pull[1, 1])
    z = np.empty(len(good))
    z[np.repeat(first, length) + (np.arange(len(good)) - np.repeat(np.append(0, np.cumsum(length)[:-1]), length))] = np.repeat(log_z, length)
    out = np.empty(len(log_z))
    out[order] = log_z
    return np.exp(np.minimum(a[:, 1] + b[:, 1] - z, 0)), pairs, out


def fit_chain(texts: list[str], labels: np.ndarray, steps: int = 150, decay: float = 1e-3, rate: float = 0.1) -> Chain:
    """Conditional likelihood with both kinds of documents weighing alike, by Adam over the whole sample."""
    if len(set(labels.tolist())) < 2:
        raise ValueError("labels of both kinds are needed")
    x, weight, per_text = line_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x -= mean
    x /= scale
    y = np.repeat(labels, per_text)
    first = np.append(0, np.cumsum(per_text)[:-1])
    inner = np.ones(len(y), bool)
    inner[first] = False
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    p = np.zeros(x.shape[1] + 4)
    m, v, total = np.zeros_like(p), np.zeros_like(p), len(y)
    for step in range(1, steps + 1):
        w, pull = p[:-4], p[-4:].reshape(2, 2)
        good, pairs, _ = marginals(x @ w, pull, per_text)
        g = np.concatenate([x.T @ (y - good), (gold - pairs).ravel()]) / total - decay * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(p[:-4].copy(), p[-4:].reshape(2, 2).copy(), mean, scale)


def score_texts(chain: Chain, texts: list[str]) -> np.ndarray:
    """Length-weighted mean of the marginals, per text."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 1_000_000):
            size += len(texts[j])
            j += 1
        x, weight, per_text = line_features(texts[i:j])
        good, _, _ = marginals(chain.emissions(x), chain.pull, per_text)
        first = np.append(0, np.cumsum(per_text)[:-1])
        out.append(np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first))
        i = j
    return np.concatenate(out) if out else np.empty(0)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", sample: int = 3_000, sample_chars: int = 16_000_000, usable=None) -> Chain:
    """Chain fitted on at most `sample` labelled rows and `sample_chars` characters (a text of over a 16th of them is left out of the sample); usable: a condition on the id that a label must meet."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if usable is None else known.where(usable)
    chosen = known.groupBy(id_col).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    met = docs.select(id_col, text_of(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # at most `sample` ids
    rows = met.orderBy(F.xxhash64(id_col), id_col, "_text").limit(sample)
    before = Window.orderBy(F.xxhash64(id_col), id_col, "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where(F.length("_text") <= sample_chars // 16)
    rows = rows.withColumn("_sum", F.sum(F.length("_text")).over(before)).where(F.col("_sum") <= sample_chars).select("_text", "_label")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one task: the sample is bounded, and the driver gets the weights alone."""
        texts, marks = [], []
        for batch in batches:
            texts += batch["_text"].to_pylist()
            marks += [int(x > 0) for x in batch["_label"].to_pylist()]
        done = pickle.dumps(fit_chain(texts, np.array(marks, np.int64))) if len(set(marks)) == 2 else None
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], ["chain"])

    made = [r["chain"] for r in rows.coalesce(1).mapInArrow(thrifty(fitted), "chain binary").collect() if r["chain"] is not None]
    if not made:
        raise ValueError("labels of both kinds are needed")
    return pickle.loads(made[0])


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: the id) and score (0 to 1, higher: better)."""
    keep = [id_col] if keep is None else keep
    slim = docs.select(*keep, text_of(text_col).alias("_text"))

    def each(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = pa.array(score_texts(chain, part["_text"].to_pylist()))
        yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), scores], [*keep, "score"])

    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return in_slices(slim, each, f"{schema}, score double")


def keep_good(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs whose score is `least` or more, with all their columns as they are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        step = 256  # few texts at a time are Python objects
        out = pa.array(np.concatenate([np.empty(0), *(score_texts(chain, text.slice(i, step).to_pylist()) for i in range(0, len(text), step))]))
        give_back()
        return out

    return docs.where(scored(text_of(text_col)) >= least)
