"""Shared pieces of the training-data operators: text columns, shared folder, sums over blocks, lists of rows to drop."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Fixed value: the six ASCII white-space characters, as a character class.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch() named, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on between tasks, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def thrifty(run):
    """run(batches), and memory goes back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def in_batches(rows: DataFrame, run, schema: str, id_col: str = "id") -> DataFrame:
    """rows.mapInPandas(run, "id ..., " + schema). Integral ids travel as text: beside nulls, pandas would make floats of them, which hold no more than 53 bits."""
    kind, run = rows.schema[id_col].dataType, thrifty(run)
    if not isinstance(kind, IntegralType):
        return rows.mapInPandas(run, f"`{id_col}` {kind.simpleString()}, {schema}")
    return rows.withColumn(id_col, F.col(id_col).cast("string")).mapInPandas(run, f"`{id_col}` string, {schema}").withColumn(id_col, F.col(id_col).cast(kind))


def in_slices(rows: DataFrame, each, schema: str, step: int = 256) -> DataFrame:
    """Arrow batches of rows, `step` rows of each at a time, through each(part), which yields batches of the schema. So few texts at a time become Python objects, and ids stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield from each(batch.slice(i, step))
            give_back()

    return rows.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def starts(totals: DataFrame, group: list[str], high: list[str], order: list[str], n: str, out: str) -> DataFrame:
    """Add the sum of n over the rows before, within a group, in the order (high, order).

    Sums run on two levels: inside each (group, high), and over the sums of these, so no task holds all totals of a group.
    """
    inner = Window.partitionBy(*group, *high).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(*high).rowsBetween(Window.unboundedPreceding, -1)
    upper = totals.groupBy(*group, *high).agg(F.sum(n).alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(outer), F.lit(0)))
    upper = upper.select(*(F.col(c).alias(f"_u{i}") for i, c in enumerate([*group, *high])), "_base")
    same = F.lit(True)
    for i, c in enumerate([*group, *high]):
        same = same & F.col(c).eqNullSafe(F.col(f"_u{i}"))
    added = totals.withColumn("_inner", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(upper, same)
    return added.withColumn(out, F.col("_base") + F.col("_inner")).select(*totals.columns, out)


#: Most rows of a narrow list (some 30 bytes a row) that is sent to all executors; longer lists are joined by a shuffle.
MOST_SENT = 500_000


def sized(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """rows as a stable table, marked to be sent to all executors if there are few enough of them."""
    stable = cut(rows)
    return F.broadcast(stable) if stable.count() <= most else stable


def without(docs: DataFrame, marks: DataFrame, id_col: str, key: Column, columns: list[str]) -> DataFrame:
    """docs without the rows that marks names: (id, key, once), once false to drop all rows of (id, key), true to keep one of them.

    Texts stay where they are if the list is short; else one anti-join shuffles them. Only rows that are there several times go through a window.
    """
    marks = cut(marks)
    some = marks.groupBy("once").count().collect()
    n = {r["once"]: r["count"] for r in some}
    if not n:
        return docs.select(*columns)
    listed = marks.select(F.col("id").alias("_mid"), F.col("key").alias("_mkey"), F.col("once").alias("_once"))
    listed = F.broadcast(listed) if sum(n.values()) <= MOST_SENT else listed
    keyed = docs.withColumn("_key", key)
    same = lambda marked: keyed[id_col].eqNullSafe(marked["_mid"]) & (keyed["_key"] == marked["_mkey"])
    left = keyed.join(listed, same(listed), "left_anti").select(*columns)
    if n.get(True):
        again = listed.where("_once")
        first = F.row_number().over(Window.partitionBy(id_col, "_key").orderBy(id_col))
        left = left.unionByName(keyed.join(again, same(again), "left_semi").withColumn("_nth", first).where("_nth = 1").select(*columns))
    return left
