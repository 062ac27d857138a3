"""Contiguous shards of equal byte size from global prefix sums, DataFrame functions only.

Rows shrink to (order columns, size, checksum) at the scan; texts don't travel. The narrow rows are range-partitioned by the order once and kept as a
table that names their range. Each range gives its total of bytes and rows; prefix sums over these few totals tell every range what lies before it, and a window inside the
range adds the rest. The row whose bytes have their middle at m of T goes to shard m * n / T: shards are contiguous in the order, none is off its share by more
than the half of a row at either cut, and a hot key (many rows of one id, or of one text) is cut like anything else. The place in a shard is the
row's global number less the number of the shard's first row.

A group of equal texts isn't kept together: with a third of all rows it could not be in one of 40 equal shards. With order=["text_key", "doc_id"], where text_key is a hash of the text, equal
texts are neighbours, so that at most one group is split at each of the cuts.

Defined cases: null text has no bytes and the checksum of an empty text; null order values come last; rows that agree in everything are rows of their own; more shards
than rows leave shards empty; an empty table gives no rows; extra columns are ignored by `assign`; in `sharded`, columns named shard and slot are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_SENT, cut, partitions, text_of

#: Fixed value: bytes that every row counts besides its text.
OVERHEAD = 16


def row_size(text_col: str = "text") -> Column:
    return F.octet_length(text_of(text_col)).cast("long") + F.lit(OVERHEAD)


def _ranged(rows: DataFrame, order: list[Column], ranges: int) -> DataFrame:
    """rows with _range, the number of their range of the order, as a stable table."""
    dealt = cut(rows).repartitionByRange(ranges, *order)
    return cut(dealt.withColumn("_range", F.spark_partition_id()))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", order: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """One row per row of docs: id, text_key, size, text_crc32, shard (from 0), slot (from 0 in each shard, gapless).

    order: columns of docs, or text_key, that give the global order; the id unless given.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    named = list(order) or [id_col]
    text = text_of(text_col)
    taken = {f"_o{i}": F.xxhash64(text) if c == "text_key" else F.col(c) for i, c in enumerate(named)}
    rows = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("text_key"), row_size(text_col).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *(c.alias(k) for k, c in taken.items()), F.monotonically_increasing_id().alias("_row"),
    )
    # the number of the row spreads rows that agree in all else, whose places may be exchanged
    by = [F.asc_nulls_last(c) for c in [*taken, "_id", "size", "text_crc32", "text_key", "_row"]]
    rows = _ranged(rows, by, ranges or partitions(docs.sparkSession))
    # sums over as many totals as there are ranges
    totals = rows.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"), F.sum("_bytes").over(every).alias("_all")
    )
    inside = Window.partitionBy("_range").orderBy(*by)
    placed = (
        rows.withColumn("_at", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(totals) if (ranges or partitions(docs.sparkSession)) <= MOST_SENT else totals, "_range")
    )
    # twice the middle of the row over twice the total; decimals, as bytes times shards can pass 2^63
    middle = F.expr(f"(2 * cast(_bytes_before + _at AS decimal(20,0)) + size) * {shards} div (2 * cast(_all AS decimal(20,0)))")
    placed = placed.withColumn("shard", F.least(middle.cast("int"), F.lit(shards - 1))).withColumn("_number", F.col("_rows_before") + F.col("_nth"))
    placed = cut(placed.select("_id", "text_key", "size", "text_crc32", "shard", "_number"))
    first = placed.groupBy("shard").agg(F.min("_number").alias("_first"))
    known = placed.join(F.broadcast(first) if shards <= MOST_SENT else first, "shard")
    return known.select(F.col("_id").alias(id_col), "text_key", "size", "text_crc32", "shard", (F.col("_number") - F.col("_first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with shard and slot. Rows find their places by (id, text hash); only rows that agree in both are numbered to be told apart."""
    places = assign(docs, shards, id_col, text_col, **more)
    # places of rows that agree are one list; such a row takes its nth entry
    alike = places.groupBy(F.col(id_col).alias("_pid"), F.col("text_key").alias("_pkey")).agg(F.count("*").alias("_n"), F.min(F.struct("shard", "slot")).alias("_only"))
    keyed = docs.drop("shard", "slot").withColumn("_key", F.xxhash64(text_of(text_col)))
    same = lambda other: keyed[id_col].eqNullSafe(other["_pid"]) & (keyed["_key"] == other["_pkey"])
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    single = alike.where("_n = 1")
    out = keyed.join(single, same(single)).select(*kept, F.col("_only.shard").alias("shard"), F.col("_only.slot").alias("slot"))
    several = alike.where("_n > 1").select("_pid", "_pkey")
    numbered = lambda w: F.row_number().over(w)
    again = keyed.join(several, same(several), "left_semi").withColumn("_nth", numbered(Window.partitionBy(id_col, "_key").orderBy("_key")))
    theirs = places.select(F.col(id_col).alias("_pid"), F.col("text_key").alias("_pkey"), "shard", "slot").join(several.withColumnsRenamed({"_pid": "_sid", "_pkey": "_skey"}), F.expr("_pid <=> _sid AND _pkey = _skey"), "left_semi")
    theirs = theirs.withColumn("_mth", numbered(Window.partitionBy("_pid", "_pkey").orderBy("shard", "slot")))
    more_rows = again.join(theirs, again[id_col].eqNullSafe(theirs["_pid"]) & (again["_key"] == theirs["_pkey"]) & (again["_nth"] == theirs["_mth"])).select(*kept, "shard", "slot")
    return out.unionByName(more_rows)


def write_shards(docs: DataFrame, path: str, shards: int = 40, **more) -> None:
    """Parquet under path/shard=K, rows in the order of their slots; a shard is as many files as its ranges, so that no task holds a whole one."""
    rows = sharded(docs, shards, **more)
    tasks = max(shards, partitions(docs.sparkSession))
    rows.repartitionByRange(tasks, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
