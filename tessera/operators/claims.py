"""The repository's statements as rules and comparisons read them: the best ranks, those that a run's rows need, and a table laid out for joins without a shuffle.

Statements (item, property, rank, item_value, text_value, ...) are by far the larger side of every join: a run has at most some hundred thousand rows, the repository has billions of statements.
So they are filtered by property at the scan, and met by the keys of the run's rows before anything is grouped or shuffled (`reduced`): few keys are sent to all tasks,
which makes a filter of them while the statements are scanned; many keys meet the layout, where both sides agree in how they are bucketed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import scratch

#: Most keys (some 50 bytes each) that are sent to all tasks; they are counted first.
MOST_SENT = 500_000


def truthy(claims: DataFrame) -> DataFrame:
    """Statements of the best rank that their item and property have, without deprecated ones; all of them, where ranks aren't known."""
    if "rank" not in claims.columns:
        return claims
    top = F.max(F.col("rank") == "preferred").over(Window.partitionBy("property", "item"))
    return claims.where("rank <> 'deprecated'").withColumn("_top", top).where("NOT _top OR rank = 'preferred'").drop("_top")


def reduced(claims: DataFrame, rows: DataFrame, keys: dict[str, str], send: bool = True) -> DataFrame:
    """claims that agree with one of the rows in the keys (column of claims: column of rows). send: the rows' keys are few enough to be sent to all tasks."""
    asked = rows.select(*(F.col(r).alias(f"_{c}") for c, r in keys.items()))
    for c in asked.columns:
        asked = asked.where(F.col(c).isNotNull())
    same = [F.col(c) == F.col(f"_{c}") for c in keys]
    asked = asked.distinct()
    return claims.join(F.broadcast(asked) if send else asked, same, "left_semi")


def of_rows(claims: DataFrame, rows: DataFrame, keys: dict[str, str], most: int = MOST_SENT) -> DataFrame:
    """reduced(), after the rows are counted."""
    return reduced(claims, rows, keys, rows.limit(most + 1).count() <= most)


def values_of(claims: DataFrame) -> DataFrame:
    """(property, kind, value, item) of statements with an item or a text as their value."""
    kinds = [("v_item", "item_value"), ("v_text", "text_value")]
    held = claims.select("item", "property", F.explode(F.array(*(F.struct(F.lit(v).alias("kind"), F.col(c).cast("string").alias("value")) for v, c in kinds))).alias("h"))
    return held.where("h.value IS NOT NULL").select("property", "h.kind", "h.value", "item")


@dataclass(frozen=True)
class ClaimTable:
    """Statements in two tables: by property and item, and by property and value. A join or a group on these keys moves no statement."""

    by_item: DataFrame
    by_value: DataFrame
    names: tuple[str, str]

    def drop(self) -> None:
        for name in self.names:
            self.by_item.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def lay_out(claims: DataFrame, buckets: int, name: str | None = None, path: str | None = None) -> ClaimTable:
    """Write both tables (under `path`, or a new folder of the shared one), bucketed by their keys and sorted by them within a bucket, so that a filter on one property skips most row groups.

    buckets: as many as keep a bucket at some hundred megabytes; the number stays with the table. A table of the name is replaced.
    """
    spark = claims.sparkSession
    name, path = name or f"claims_{uuid.uuid4().hex}", path or scratch(spark, "claims")
    made = []
    for suffix, rows, key in (("item", claims, ["property", "item"]), ("value", values_of(claims), ["property", "kind", "value"])):
        table = f"{name}_by_{suffix}"
        # each task has whole buckets, so there is one file a bucket
        (rows.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", f"{path}/{suffix}").saveAsTable(table))
        made.append(table)
    return laid_out(spark, tuple(made))


def laid_out(spark: SparkSession, names: tuple[str, str]) -> ClaimTable:
    return ClaimTable(spark.table(names[0]), spark.table(names[1]), names)


def properties_of(claims: DataFrame) -> DataFrame:
    """item, properties: the properties of which an item has statements, of any rank, sorted."""
    return claims.groupBy("item").agg(F.array_sort(F.collect_set("property")).alias("properties"))


def text_rows(rows: DataFrame) -> Column:
    """The rows' text values but for texts in a language, which no other statement is compared with."""
    return F.when(F.col("datatype") != "monolingualtext", F.col("v_text")) if "datatype" in rows.columns else F.col("v_text")
