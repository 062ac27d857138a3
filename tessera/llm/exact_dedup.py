"""Exact dedup: tree-merge of sorted digest runs, DataFrame operations only.

Rows are dealt to 2^k runs by their id. A run is a table of one entry per digest (smallest id, count), sorted by digest. At
each level, the runs whose numbers agree after dropping `fan_bits` more bits are merged, so partitions exchange runs in binomial rounds:
entries go to (new run, digest range), are sorted there, and one pass over equal neighbours keeps the smallest identifier and the sum of the counts.
As runs grow by 2^fan_bits, they are cut into as many more digest ranges; so the pieces that tasks merge stay alike in size at all levels.
Two entries are taken as equal if SHA-256, length and a second 64-bit hash of the normalised text agree; the texts themselves don't
travel. The decisions go the way back: each (run, digest) entry gets the final one, then each row joins the entry of its own run. So a text that
a third of all rows share meets, in any one task, only the rows of a run and one entry per run.

Defined cases: null text is empty text; a null id ranks after all others; of rows with equal id and equal text exactly one is
kept; an empty table gives no rows; extra columns stay, those that clash with result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, partitions, text_of, without

KEY = ["_sha", "_len", "_check"]


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), f"{SPACE}+", " ")


def _digests(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    run = F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int")
    return (
        docs.withColumn("_norm", normalised(text_col))
        .withColumn("_sha", F.unhex(F.sha2("_norm", 256)))
        .withColumn("_len", F.octet_length("_norm"))
        .withColumn("_check", F.xxhash64("_norm"))
        .withColumn("_run", run)
        .drop("_norm")
    )


def _deal(spark, runs: int | None) -> int:
    """Runs: four per shuffle partition, as a power of two."""
    return runs or 1 << max(3, (4 * partitions(spark) - 1).bit_length())


def _merged(entries: DataFrame, shift: int) -> DataFrame:
    """Sorted runs of a level -> those of the next one; shift: bits of the run's number dropped so far, which is also the number of bits that cut digests into ranges."""
    dealt = entries.withColumn("_run", F.shiftright("_leaf", shift)).withColumn("_range", F.shiftright("_top", 32 - shift))
    run = dealt.repartition("_run", "_range").sortWithinPartitions("_run", "_range", *KEY, F.asc_nulls_last("_min"))
    equal = Window.partitionBy("_run", "_range", *KEY)
    first = run.withColumn("_nth", F.row_number().over(equal.orderBy(F.asc_nulls_last("_min")))).withColumn("_n", F.sum("_n").over(equal))
    return first.where("_nth = 1").select("_leaf", "_top", *KEY, "_min", "_n")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """(narrow rows with their run and digest, (run, digest) entries with keep_id and group_size); rows are a stable table."""
    runs = _deal(docs.sparkSession, runs)
    rows = cut(_digests(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", runs).drop("_text"))
    leaves = rows.groupBy("_run", *KEY).agg(F.min("_id").alias("_min"), F.count("*").alias("_n"))
    top = F.conv(F.hex(F.substring("_sha", 1, 4)), 16, 10).cast("long")
    level, shift, bits = leaves.select(F.col("_run").alias("_leaf"), top.alias("_top"), *KEY, "_min", "_n"), 0, min(32, runs.bit_length() - 1)
    while shift < bits:
        shift += min(fan_bits, bits - shift)
        level = _merged(level, shift)
    final = level.select(*KEY, F.col("_min").alias("keep_id"), F.col("_n").alias("group_size"))
    return rows, leaves.select("_run", *KEY).join(final, KEY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    rows, entries = decisions(docs, id_col, text_col, runs)
    nth = F.row_number().over(Window.partitionBy("_run", *KEY, "_id").orderBy("_id"))
    return (
        rows.join(entries, ["_run", *KEY]).withColumn("_nth", nth)
        .select(
            F.col("_id").alias(id_col), "keep_id", "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """docs without the rows that exact_dedup doesn't keep; all columns stay as they are. The rows to drop are found first, on digests alone."""
    rows, entries = decisions(docs, id_col, text_col, runs)
    met = rows.join(entries.where("group_size > 1"), ["_run", *KEY]).withColumn("_stays", F.col("_id").eqNullSafe(F.col("keep_id")))
    marks = met.groupBy(F.col("_id").alias("id"), F.col("_check").alias("key")).agg(F.max("_stays").alias("once"), F.count("*").alias("_n"))
    return without(docs, marks.where("NOT once OR _n > 1").select("id", "key", "once"), id_col, F.xxhash64(normalised(text_col)), docs.columns)
