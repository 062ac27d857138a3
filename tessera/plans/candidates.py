"""Candidate pages: the scan of a template's transclusions and the filter cascade that accounts for every page it drops."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.closure import LimitExceeded


def transclusions(linktarget: DataFrame, templatelinks: DataFrame, page: DataFrame, page_props: DataFrame, template: str, namespace: int = 0) -> DataFrame:
    """Pages of a namespace that use the template, with their item, newest revision first."""
    target = linktarget.where((F.col("namespace") == 10) & (F.col("title") == template)).select(F.col("lt_id").alias("target_id"))
    props = page_props.where("name = 'wikibase_item'").select("page_id", F.col("value").alias("item"))
    pages = page.where(F.col("namespace") == namespace).select("page_id", "title", "latest_revision")
    links = templatelinks.where(F.col("from_namespace") == namespace).join(target, "target_id", "left_semi").select(F.col("from_id").alias("page_id")).distinct()
    return links.join(pages, "page_id").join(props, "page_id", "left").select("page_id", "title", "item", "latest_revision")


def newest_first(pages: DataFrame) -> DataFrame:
    return pages.orderBy(F.desc("latest_revision"), "page_id")


def limited(rows: DataFrame, most: int) -> DataFrame:
    """rows, or LimitExceeded if there are more; reads at most one row too many."""
    if rows.limit(most + 1).count() > most:
        raise LimitExceeded(f"more than {most} candidates")
    return rows


@dataclass
class Filters:
    """Each filter is optional. category, saved_pages: page_id; saved_items, query_items, class_items, set_items: item."""

    category: DataFrame | None = None
    manual: list[str] = field(default_factory=list)
    saved_pages: DataFrame | None = None
    saved_items: DataFrame | None = None
    query_items: DataFrame | None = None
    class_items: DataFrame | None = None
    set_items: DataFrame | None = None


def _marked(pages: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """pages with a flag: is the key among keys? One left join, no row is lost or repeated. Pages without a key are spread by their page id, not sent to one task."""
    known = keys.select(F.col(key).cast("string").alias("_key")).where("_key IS NOT NULL").distinct().withColumn(flag, F.lit(True))
    asked = pages.withColumn("_of", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.col("page_id").cast("string"))))
    return asked.join(known, F.col("_of") == F.col("_key"), "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("_key", "_of")


def cascade(pages: DataFrame, filters: Filters) -> DataFrame:
    """pages with `reason`: the first stage that drops the page, null for candidates. Stages stand in a fixed order."""
    stages, out = [], pages
    if filters.category is not None:
        out = _marked(out, filters.category, "page_id", "_category")
        stages.append(("not_in_category", ~F.col("_category")))
    if filters.manual:
        stages.append(("not_in_list", ~(F.col("title").isin(*filters.manual) | F.coalesce(F.col("item").isin(*filters.manual), F.lit(False)))))
    if filters.saved_pages is not None:
        out = _marked(out, filters.saved_pages, "page_id", "_saved")
        stages.append(("not_in_saved_query", ~F.col("_saved")))
    if filters.saved_items is not None:
        out = _marked(out, filters.saved_items, "item", "_saved_item")
        stages.append(("not_in_saved_query", ~F.col("_saved_item")))
    if filters.query_items is not None:
        out = _marked(out, filters.query_items, "item", "_query")
        stages.append(("not_in_query", ~F.col("_query")))
    stages.append(("no_item", F.col("item").isNull()))
    if filters.class_items is not None:
        out = _marked(out, filters.class_items, "item", "_class")
        stages.append(("not_in_class", ~F.col("_class")))
    if filters.set_items is not None:
        out = _marked(out, filters.set_items, "item", "_set")
        stages.append(("already_set", F.col("_set")))
    reason = F.coalesce(*(F.when(dropped, F.lit(name)) for name, dropped in stages))
    return out.withColumn("reason", reason).select(*pages.columns, "reason")


def excluded(marked: DataFrame) -> DataFrame:
    """Dropped pages per reason."""
    return marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def numbered_rows(candidates: DataFrame, fields: int, run_id: int, rows_per_block: int = 100_000) -> DataFrame:
    """run rows: every candidate times every field, numbered from 0 in the order (newest revision, page, field).

    Numbers are dense over all rows without a sort in one place: blocks are ranges of revisions, and only their counts are summed in one window.
    """
    rows = candidates.withColumn("field", F.explode(F.sequence(F.lit(0), F.lit(fields - 1)))).withColumn("run_id", F.lit(run_id))
    keyed = rows.withColumn("_block", F.floor(-F.coalesce("latest_revision", F.lit(0)) / rows_per_block))
    starts = keyed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy(F.desc("latest_revision"), "page_id", "field")
    return keyed.withColumn("_row", F.row_number().over(within)).join(starts, "_block").withColumn("seq", F.col("_start") + F.col("_row") - 1).drop("_block", "_row", "_start")
