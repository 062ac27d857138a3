"""Packing by power-of-two decomposition.

A document's token ids, with an end id, are cut into pieces whose lengths are powers of two: as many of the longest length as
fit, then one piece for each bit that is set in the rest, longest first. Each piece is a sequence of its own; sequences of equal length form
a bucket and are numbered one after the other, so a batch of a bucket needs no padding and no sequence crosses documents.

A tokenizer file whose normaliser and pre-tokenizer are the ones in KNOWN (lower case, white space dropped) is asked for pieces only, and
these are kept in a bounded cache: its pre-tokenizer never crosses white space, so the ids of a text are those of its chunks; texts of
ASCII and Latin letters are cut further, as the pre-tokenizer does, since pieces repeat more often. Texts that spell a special token, and all texts
of any other tokenizer, go through the tokenizer whole.

Defined cases: null text is empty and gives the end id alone; repeated rows are documents of their own, told apart by
`copy` (0, 1, ...); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, sized, text_of, thrifty

_STATE: dict = {}


# Letters of the fast path (ASCII and Latin letters that lower-case one to one) and the pre-tokenizer's pattern over them.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-\u012f\u0131-ž"
_PLAIN = re.compile(f"[\\t-\\r -~{_LETTERS}]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \\t\\n\\r\\f\\v{_LETTERS}0-9]+")
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")


# The settings of a tokenizer file that the patterns above stand for.
KNOWN = {
    "truncation": None, "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def can_cut(settings: dict) -> bool:
    """Do a tokenizer file's settings (its JSON) give a text the ids of its pieces, one after the other?"""
    added = settings.get("added_tokens", [])
    plain = all(not any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for x in added)
    return plain and settings.get("post_processor") is None and not settings.get("model", {}).get("dropout") and all(settings.get(k) == v for k, v in KNOWN.items())


class Ids:
    """Ids of one tokenizer file, by cached pieces where its settings allow; one per worker process."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.cache, self.old = Tokenizer.from_file(path), keep, {}, {}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.cuts = can_cut(json.load(f))
        self.narrow = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def many(self, texts: list[str], end: int, chars: int = 1_000_000) -> Iterator[np.ndarray]:
        """Ids of each text and the end id; unknown pieces of about `chars` characters of text go to the tokenizer together."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < chars):
                size += len(texts[j])
                j += 1
            yield from self._some(texts[i:j], end)
            i = j

    def learn(self, fresh: list[str], most: int = 20_000) -> None:
        """Put the ids of pieces into the cache. Pieces of letters, digits or signs alone are words of the pre-tokenizer: many go as one text, and its words are theirs, one by one."""
        single = [w for w in fresh if _PIECE.fullmatch(w)]
        rest = [w for w in fresh if not _PIECE.fullmatch(w)] if len(single) < len(fresh) else []
        for i in range(0, len(single), most):
            words = single[i : i + most]
            e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
            if len(first) != len(words):  # not as expected: one by one
                rest += words
                continue
            data, cuts = np.array(e.ids, np.uint32).tobytes(), (4 * np.append(first, len(of))).tolist()
            self.cache.update(zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else (), strict=True):
            self.cache[w] = array("I", e.ids).tobytes()

    def _some(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        if not self.cuts:
            for e in self.tokenizer.encode_batch(texts, add_special_tokens=False):
                yield np.array([*e.ids, end], np.uint32)
            return
        # texts in plain letters are cut as the pre-tokenizer cuts them; others at white space only
        cut = [None if any(s in t for s in self.special) else _PIECE.findall(t.lower()) if _PLAIN.fullmatch(t) else _CHUNK.findall(t) for t in texts]
        if len(self.cache) > self.keep // 2:  # two generations: what was used in the last one comes along when it is used again
            self.cache, self.old = {}, self.cache
        cache, missing = self.cache, set().union(*(w for w in cut if w)).difference(self.cache)
        known = missing.intersection(self.old)
        cache.update((w, self.old[w]) for w in known)
        self.learn(list(missing.difference(known)))
        last = np.uint32(end).tobytes()
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], np.uint32)
            else:
                yield np.frombuffer(b"".join([*map(cache.__getitem__, words), last]), np.uint32)


#: Pieces whose ids a worker keeps, some 200 bytes each, unless a caller says otherwise.
KEEP = 400_000


def ids_of(path: str, keep: int = KEEP) -> Ids:
    if (path, keep) not in _STATE:
        _STATE[path, keep] = Ids(path, keep)
    return _STATE[path, keep]


def decompose(n: int, longest: int = 2048) -> list[int]:
    """n as lengths that are powers of two, none over `longest` (a power of two itself), longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


SCHEMA = "row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end: int = 1, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """One row per piece: id, row_key (a hash of the text), row (a number for the document's row), start, length, ids_crc32, doc_tokens and, if asked
    for, ids (binary, unsigned 32-bit numbers; 16-bit where the vocabulary allows)."""

    names = ["id", "row_key", *(x.split()[0] for x in SCHEMA.split(", ")), *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(tokenizer, keep)
        number = TaskContext.get().partitionId() << 33
        for part in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):  # few texts at a time are Python objects
            at, rows, kept = [], [[], [], [], [], []], []
            for i, ids in enumerate(encode.many(part["text"].to_pylist(), end)):
                start = 0
                data = memoryview(ids.astype("<u4").tobytes())
                narrow = ids.astype(encode.narrow) if with_ids else None
                for n in decompose(len(ids), longest):
                    at.append(i)
                    for column, x in zip(rows, (number, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), len(ids)), strict=True):
                        column.append(x)
                    if with_ids:
                        kept.append(narrow[start : start + n].tobytes())
                    start += n
                number += 1
            columns = [part["id"].take(pa.array(at)), part["row_key"].take(pa.array(at)), *(pa.array(x, pa.int64()) for x in rows)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())] if with_ids else columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("row_key"), text_of(text_col).alias("text"))
    return rows.mapInArrow(thrifty(run), f"id {rows.schema['id'].dataType.simpleString()}, row_key bigint, {SCHEMA}" + ", ids binary" * with_ids)


def _numbered(stable: DataFrame, longest: int, with_ids: bool) -> DataFrame:
    """Add sequence_id: dense, by length, then partition of the checkpoint, then place in it. Rows stay where they are.

    What each task must know is the number of its first sequence of each length: partitions times lengths, 8 bytes each.
    """
    lengths = [1 << b for b in range(longest.bit_length())]
    counts = np.zeros((len(lengths), stable.rdd.getNumPartitions()), np.int64)
    for r in stable.groupBy("length", F.spark_partition_id().alias("p")).count().collect():
        counts[int(r["length"]).bit_length() - 1, r["p"]] = r["count"]
    begin = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(counts.shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = begin[:, TaskContext.get().partitionId()].copy()
        for batch in batches:
            which = np.log2(batch["length"].to_numpy(np.int64)).astype(np.int64)
            nth = pd.Series(which).groupby(which).cumcount().to_numpy()
            batch = batch.assign(sequence_id=at[which] + nth)
            at += np.bincount(which, minlength=len(at))
            for i in range(0, len(batch), 1_000 if with_ids else max(1, len(batch))):  # ids are widened for few pieces at a time
                part = batch.iloc[i : i + 1_000] if with_ids else batch
                yield part.assign(ids=[np.frombuffer(x, f"<u{len(x) // n}").astype(np.int32) for x, n in zip(part["ids"], part["length"], strict=True)]) if with_ids else part

    return in_batches(stable, run, f"row_key bigint, {SCHEMA}" + ", ids array<int>" * with_ids + ", sequence_id bigint")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end: int = 1, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """Pieces with sequence_id (dense, bucket by bucket, longest bucket last), offset (always 0), copy and, if asked for, ids (array<int>)."""
    stable = cut(pieces(docs, tokenizer, id_col, text_col, longest, end, with_ids, keep))
    out = _numbered(stable, longest, with_ids)
    # rows that share id and text: their pieces are numbered by the row
    same = Window.partitionBy("id", "row_key").orderBy("row")
    again = stable.where("start = 0").select(F.col("row").alias("_row"), (F.row_number().over(same) - 1).cast("long").alias("_copy")).where("_copy > 0")
    out = out.join(sized(again), F.col("row") == F.col("_row"), "left")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.coalesce("_copy", F.lit(0).cast("long")).alias("copy"), *(["ids"] if with_ids else []))
