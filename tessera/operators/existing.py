"""Candidate values against what items have, had, or had removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import mentions
from tessera.operators.claims import of_rows


def of_items(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """The statements of the rows' items; found while the claims are scanned, where the items are few."""
    return of_rows(claims, rows, {"item": "item"})


def already_there(rows: DataFrame, claims: DataFrame, same, any_value: bool = False) -> DataFrame:
    """rows (row_id, item, property, ...) with skip: the value's message first, then, if any_value, the property's.

    same: a condition over row and claim columns (the claim's are prefixed c_). A deprecated statement doesn't count for the value, but for the
    property; one join on (item, property) and one aggregation.
    """
    known = claims.select(*(F.col(c).alias(f"c_{c}") for c in claims.columns))
    met = rows.join(known, (rows["item"] == known["c_item"]) & (rows["property"] == known["c_property"]))
    flags = met.groupBy("row_id").agg(F.max(F.coalesce(same & (F.col("c_rank") != "deprecated"), F.lit(False))).alias("_value"))
    skip = F.when(F.col("_value"), F.lit("the item already has this value"))
    if any_value:
        skip = F.coalesce(skip, F.when(F.col("_value").isNotNull(), F.lit("the item already has the property")))
    return rows.join(flags, "row_id", "left").withColumn("skip", skip).drop("_value")


def removed_before(rows: DataFrame, history: DataFrame, latest: int = 500) -> DataFrame:
    """rows (item, property, value) whose value one of the item's `latest` summaries says was removed."""
    recent = of_rows(history, rows, {"item": "item"})
    recent = recent.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("rev")))).where(F.col("_n") <= latest)
    removals = recent.where(F.col("comment").contains("wbremoveclaims-remove")).select(F.col("item").alias("_item"), "comment")
    needle = F.concat(F.lit("[[Property:"), F.col("property"), F.lit("]]: "), F.col("value"))
    return rows.join(removals, (rows["item"] == removals["_item"]) & mentions(F.col("comment"), needle), "left_semi")
