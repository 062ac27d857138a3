"""A run from its specification: the candidate pages, what was left out and why, and the outcomes."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import title
from tessera.operators import closure
from tessera.sources import lookups

from . import candidates
from .evaluate import Catalog, Field, evaluate_fields
from .job import JobSpec
from .lineage import checkpointed
from .pages import PageSource, TableSource, Wiki, first_that_works  # noqa: F401
from .properties import Prepared, Site, plain_site


def manual_names(entries: tuple[str, ...], spark) -> list[str]:
    """Titles as they are stored (any spacing, lower-case first letter) and item ids, of a user's own list."""
    rows = spark.createDataFrame([(e,) for e in entries], "e string").select(title(F.col("e")).alias("t")).where("t <> ''").distinct()
    return sorted(r["t"] for r in rows.collect())


def candidate_pages(spec: JobSpec, wiki: Wiki, saved: DataFrame | None = None, saved_wiki: str | None = None, most_pages: int = 500_000, most_categories: int = 20_000, site: Site | None = None, source: PageSource | None = None) -> DataFrame:
    """Pages that use the template, with `reason`: the filter of the specification that drops them, null for candidates.

    saved: page_id, namespace, title of the saved query that the specification names, on saved_wiki. site: the specification's wiki, by whose rules names are read (`Prepared.site`). source: where pages are found, the wiki's tables unless given.
    """
    spark = wiki.page.sparkSession
    site = site or plain_site(spec, spark)
    source = source or TableSource(wiki)
    pages = source.transclusions(site.key(spec.template, 10), spec.namespace)
    filters = candidates.Filters(manual=manual_names(spec.manual_list, spark) if spec.manual_list else [])
    if spec.category.strip():
        # its members are joined with the template's pages, never held, so however many there are is no reason to stop
        filters.category = source.category_members(site.key(spec.category, 14), spec.depth, None, most_categories)
    if spec.saved_query is not None:
        filters.saved_pages, filters.saved_items = lookups.saved_query(saved, saved_wiki or wiki.dbname, wiki.dbname)
    if spec.items_sql.strip():
        filters.query_items = lookups.user_items(spark, spec.items_sql)
    if spec.instance_of:
        items = pages.where("item IS NOT NULL").select("item").distinct()
        filters.class_items = closure.in_classes(items, wiki.claims, wiki.subclass, list(spec.instance_of))
    # with several properties, a page may matter for one even if it has another
    if spec.skip_any_value and not spec.extra_properties:
        filters.set_items = wiki.claims.where(F.col("property") == spec.property).select("item")
    # the cascade runs once; the limit is on the pages that it has looked at
    return candidates.limited(checkpointed(candidates.cascade(pages, filters)), most_pages)


def excluded_json(marked: DataFrame) -> str:
    """What a run keeps of its dropped pages: the number per reason."""
    return json.dumps({r["reason"]: r["n"] for r in candidates.excluded(marked).orderBy("reason").collect()})


def catalog_of(prepared: Prepared, catalog: Catalog) -> Catalog:
    """The catalog with what is known of the specification's own wiki: references name it, and its templates, files, dates and namespaces are read by its rules."""
    site = prepared.site
    return replace(catalog, host=site.host, dbname=site.dbname or catalog.dbname, language=site.language, edition=site.edition, prefixes=site.template_prefixes, file_prefixes=site.file_prefixes, namespaces=site.namespaces, first_letter=site.first_letter, months=site.months)


def outcomes(prepared: Prepared, marked: DataFrame, revisions: DataFrame, catalog: Catalog) -> DataFrame:
    """Outcomes of the candidates for the main property (field 0) and the extra ones (1, 2, ...); pages are read once for all of them."""
    pages = marked.where("reason IS NULL").select("page_id", "title", "item")
    fields = [Field(one.spec, one.property.datatype, one.rules, one.datatypes, one.units) for one in (prepared, *prepared.extras)]
    return evaluate_fields(pages, revisions, fields, catalog_of(prepared, catalog))
