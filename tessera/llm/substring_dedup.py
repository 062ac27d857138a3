"""Substring dedup by line hashing.

A text is cut into units: lines of `line_words` words or more, and inside lines, sentences of `sentence_words` words or more, so that a passage
is also found where the rest of its line differs. A unit is normalised (A-Z lower-cased, ASCII white space as one space, trimmed) and
hashed to 128 bits. (13 words is the usual length from which an overlap is taken as a copy; shorter repeated lines are mostly phrases that clean texts share.) Shorter pieces go with the passage they belong to: every two neighbouring pieces (sentences, or lines of one sentence, of any length)
are hashed as a pair, and a run of consecutive repeated pairs of `passage_words` words or more is removed as one span. Digests are grouped over all documents; of each digest that occurs more than once, the earliest occurrence, in the order of
(id, text key, start), stays and the others are removed. Removed spans keep their offsets (code points) in the original text.

Texts are cut and hashed once; the narrow rows are kept as a table in the shared folder. The group step combines before its shuffle, so a line that a third of all documents have is one row per task. Where a digest has
more than 1,000 rows and a 100,000th of all, it is one of 100,000 at most: these are sent to all tasks, so no task gets the occurrences of a common line; the others meet their rows in an equi-join.

Defined cases: null text is empty and has no units; null ids rank last; rows that agree in id and text are one document, so neither is removed
for the other; shorter units are never removed by themselves, only in such a run; an empty table gives no rows; extra columns stay in `deduplicated`,
columns named removed, n_removed and removed_chars are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_batches, remove, scratch, text_of

#: Digests of so many rows are no more than this; rows are counted.
MOST_FREQUENT = 100_000
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*[ \t\r\f\v]*")
_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def units(text: str, line_words: int = 13, sentence_words: int = 13) -> list[tuple[int, int, bytes]]:
    """(start, end, normalised bytes) of every unit; spans begin and end with a word."""
    out = []
    for m in _LINE.finditer(text):
        line = m[0]
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if len(words) < min(line_words, sentence_words):
            continue
        left = len(line) - len(line.lstrip(" \t\r\f\v"))
        whole = (m.start() + left, m.start() + len(line.rstrip(" \t\r\f\v")))
        if len(words) >= line_words:
            out.append((*whole, b" ".join(words)))
        if len(words) > sentence_words:
            for s in _SENTENCE.finditer(line):
                part = s[0].strip(" \t\r\f\v")
                inner = part.encode("utf-8", "surrogatepass").lower().split()
                if sentence_words <= len(inner) < len(words):
                    begin = m.start() + s.start() + len(s[0]) - len(s[0].lstrip(" \t\r\f\v"))
                    out.append((begin, begin + len(part), b" ".join(inner)))
    return out


def pieces(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised bytes, words) of every sentence, in order and of any length; together they have every line's words."""
    out = []
    for m in _LINE.finditer(text):
        begin = m.start()
        for s in _SENTENCE.finditer(m[0]):
            # what lies between two matches (signs alone) goes with the later one
            part = text[begin : m.start() + s.end()]
            words = part.encode("utf-8", "surrogatepass").lower().split()
            if words:
                left = begin + len(part) - len(part.lstrip(" \t\r\f\v"))
                out.append((left, begin + len(part.rstrip(" \t\r\f\v")), b" ".join(words), len(words)))
            begin = m.start() + s.end()
    return out


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = 13, sentence_words: int = 13) -> DataFrame:
    """(id, text_key, start, end, seq, w1, w2, d1, d2): a row per unit (seq -1), and one per two neighbouring pieces, seq the number of the first, with the words of either."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            at, spans, digests = [], [], []
            for i, text in enumerate(batch["text"]):
                for a, b, data in units(text, line_words, sentence_words):
                    at.append(i)
                    spans.append((a, b, -1, 0, 0))
                    digests.append(digest(data))
                row = pieces(text)
                for k, (x, y) in enumerate(zip(row, row[1:])):
                    at.append(i)
                    spans.append((x[0], y[1], k, x[3], y[3]))
                    digests.append(digest(x[2] + b"\n" + y[2]))
                if len(at) > 1 << 16:
                    yield framed(batch, at, spans, digests)
                    at, spans, digests = [], [], []
            if at:
                yield framed(batch, at, spans, digests)

    def framed(batch: pd.DataFrame, at: list, spans: list, digests: list) -> pd.DataFrame:
        pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        picked, numbers = batch.iloc[at], np.array(spans, np.int32)
        named = {c: numbers[:, k] for k, c in enumerate(("start", "end", "seq", "w1", "w2"))}
        return pd.DataFrame({"id": picked["id"].array, "text_key": picked["text_key"].array, **named, "d1": pairs[:, 0], "d2": pairs[:, 1]})

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key"), text_of(text_col).alias("text"))
    return in_batches(rows, run, "text_key bigint, start int, end int, seq int, w1 int, w2 int, d1 bigint, d2 bigint")


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = 13, sentence_words: int = 13, passage_words: int = 50) -> DataFrame:
    """(id, text_key, removed): per document that loses anything, its removed spans, merged, in order."""
    path = scratch(docs.sparkSession, "units")
    unit_rows(docs, id_col, text_col, line_words, sentence_words).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "start")
    seen = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = cut(seen)
    # digests that very many rows have are few, by their sum: these are sent to the rows, all others meet them in a join
    often = max(1_000, -(-rows.count() // MOST_FREQUENT))
    later = lambda met: met.where(~place.eqNullSafe(F.col("first"))).select(*(c for c in rows.columns if c not in ("d1", "d2")))
    hot = F.broadcast(seen.where(F.col("n") > often).select("d1", "d2", "first"))
    rest = rows.join(hot, ["d1", "d2"], "left_anti").join(seen.where(F.col("n") <= often).select("d1", "d2", "first"), ["d1", "d2"])
    # a stable table: units and pairs both read it
    again = cut(later(rows.join(hot, ["d1", "d2"])).unionByName(later(rest)))
    remove(docs.sparkSession, path)
    # pairs of pieces: runs over (document, position)
    marked = again.where("seq >= 0").groupBy("id", "text_key", "seq").agg(*(F.first(c).alias(c) for c in ("start", "end", "w1", "w2")))
    run = F.col("seq") - F.row_number().over(Window.partitionBy("id", "text_key").orderBy("seq"))
    runs = marked.withColumn("run", run).groupBy("id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("w1") + F.max_by("w2", "seq")).alias("words"))
    found = again.where("seq < 0").select("id", "text_key", "start", "end").union(runs.where(F.col("words") >= passage_words).select("id", "text_key", "start", "end"))
    spans = found.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]), joined).otherwise(F.array_append(done, x))

    return spans.select("id", "text_key", F.aggregate("s", F.array().cast("array<struct<start:int,end:int>>"), add).alias("removed"))


def span_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document: id, n_chars, removed (spans), n_removed, removed_chars."""
    spans = removed_spans(docs, id_col, text_col, **limits)
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_key"), F.length(text_of(text_col)).cast("long").alias("n_chars"))
    return _joined(slim, spans).select(F.col("_id").alias(id_col), "n_chars", "removed", F.size("removed").cast("long").alias("n_removed"), _chars().alias("removed_chars"))


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    same = F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_key") == F.col("_skey"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = spans.select(F.col("id").alias("_sid"), F.col("text_key").alias("_skey"), F.col("removed").alias("_spans"))
    return docs.join(found, same, "left").withColumn("removed", F.coalesce("_spans", none))


def _chars():
    return F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """docs with the removed spans cut out of the text, and removed, n_removed, removed_chars."""
    spans = removed_spans(docs, id_col, text_col, **limits)
    keyed = docs.drop("removed", "n_removed", "removed_chars").withColumn("_id", F.col(id_col)).withColumn("_key", F.xxhash64(text_of(text_col)))
    out = _joined(keyed, spans)
    text = text_of(text_col)
    # each span's text from the end of the one before, then the tail
    edges = F.concat(F.array(F.lit(0)), F.transform("removed", lambda x: x["end"]))
    begins = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(edges, begins, lambda a, b: F.substr(text, a + 1, b - a)), "")
    cut_out = F.when(F.size("removed") > 0, kept).otherwise(F.col(text_col))
    return out.withColumn("n_removed", F.size("removed").cast("long")).withColumn("removed_chars", _chars()).withColumn(text_col, cut_out).drop("_id", "_key", "_spans", "_sid", "_skey")
