"""Where candidate pages come from: the wiki's link tables, or a dump of its pages, behind one protocol, one in the other's place if it fails.

A dump is read as text whose records end with a page element's end tag, so Spark cuts its files into byte ranges, however large they are, and each task begins at the first page of its own range; a record is
parsed as XML in the JVM, and only if it may be of a wanted namespace. (Spark's own XML reader doesn't split files whose elements have several lines.) It is read once: one call per page lists the templates and
categories that it names, and these narrow rows become the same link tables as the wiki keeps, so all that follows is the same plan. (A dump doesn't tell
what templates include through other templates; the wiki's own tables do.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import wikitext as W
from tessera.functions.text import db_key
from tessera.operators import closure

from . import candidates
from .lineage import checkpointed


@dataclass
class Wiki:
    """A wiki's tables, as `candidates.transclusions` and `closure` read them, and claims of the repository."""

    linktarget: DataFrame
    templatelinks: DataFrame
    page: DataFrame
    page_props: DataFrame
    categorylinks: DataFrame
    claims: DataFrame
    subclass: DataFrame
    dbname: str


class PageSource(Protocol):
    """Names are keys of the database."""

    def transclusions(self, template: str, namespace: int) -> DataFrame:
        """page_id, title, item, latest_revision of the pages of a namespace that use the template."""

    def category_members(self, category: str, depth: int, most_pages: int | None, most_categories: int | None) -> DataFrame:
        """page_id of the pages in the category and up to `depth` levels below."""


@dataclass
class TableSource:
    """The wiki's own link tables."""

    wiki: Wiki

    def transclusions(self, template: str, namespace: int) -> DataFrame:
        w = self.wiki
        return candidates.transclusions(w.linktarget, w.templatelinks, w.page, w.page_props, template, namespace)

    def category_members(self, category: str, depth: int, most_pages: int | None, most_categories: int | None) -> DataFrame:
        seed = self.wiki.page.sparkSession.createDataFrame([(category,)], "node string")
        return closure.category_members(seed, self.wiki.categorylinks, depth, most_pages, most_categories)


@dataclass
class WithFallback:
    """The first source that can be read. What a source gives is computed before it is returned, since a plan fails when it runs; a limit that is exceeded is an answer, not a failure."""

    sources: tuple[PageSource, ...]

    def transclusions(self, template: str, namespace: int) -> DataFrame:
        return first_that_works(lambda s=s: checkpointed(s.transclusions(template, namespace)) for s in self.sources)

    def category_members(self, category: str, depth: int, most_pages: int | None, most_categories: int | None) -> DataFrame:
        return first_that_works(lambda s=s: checkpointed(s.category_members(category, depth, most_pages, most_categories)) for s in self.sources)


def first_that_works(sources: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The result of the first source that can be asked. A limit that is exceeded is raised at once."""
    last: Exception | None = None
    for ask in sources:
        try:
            return ask()
        except closure.LimitExceeded:
            raise
        except Exception as e:  # noqa: BLE001  whatever keeps a source from being read
            last = e
    raise last if last is not None else ValueError("no source")


BEGIN, END = "<page>", "</page>"
#: What is read of a page element.
PAGE = "title string, ns int, id bigint, redirect struct<_title:string>, revision struct<id:bigint,text:struct<_VALUE:string>>"


def dump_pages(spark: SparkSession, path: str, namespaces: tuple[int, ...] = ()) -> DataFrame:
    """page_id, namespace, title (with its prefix), redirect (the title it leads to), revision_id, text of an XML dump: a file or a folder of files. namespaces: those that are wanted; all if there are none."""
    records = spark.read.option("lineSep", END).text(path).where(F.contains("value", F.lit(BEGIN)))
    if namespaces:
        records = records.where(F.col("value").rlike(f"<ns>(?:{'|'.join(map(str, namespaces))})</ns>"))
    element = F.concat(F.substr("value", F.locate(BEGIN, F.col("value"))), F.lit(END))
    rows = records.select(F.from_xml(element, PAGE, {"ignoreSurroundingSpaces": "false"}).alias("p")).where("p.id IS NOT NULL")
    return rows.select(F.col("p.id").alias("page_id"), F.col("p.ns").alias("namespace"), F.trim("p.title").alias("title"), F.col("p.redirect._title").alias("redirect"), F.col("p.revision.id").alias("revision_id"), F.col("p.revision.text._VALUE").alias("text"))


def dump_revisions(spark: SparkSession, path: str) -> DataFrame:
    """page_id, revision_id, text."""
    return dump_pages(spark, path).select("page_id", "revision_id", "text")


def tables_of_dump(spark: SparkSession, path: str, items: DataFrame, claims: DataFrame, subclass: DataFrame, dbname: str, template_prefixes: tuple[str, ...] = ("Template",), category_prefixes: tuple[str, ...] = ("Category",), first_letter: bool = True) -> Wiki:
    """The link tables of a dump. items: page_id, item. A page that names a redirect to a template links to both."""
    pages = dump_pages(spark, path)
    named = W.page_links(F.col("text"), category_prefixes)
    rows = pages.select("page_id", "namespace", "title", "redirect", "revision_id", named.alias("l"))
    rows = checkpointed(rows.select("page_id", "namespace", "title", "redirect", "revision_id", F.transform("l.templates", lambda t: db_key(t, template_prefixes, first_letter)).alias("templates"), F.transform("l.categories", lambda c: db_key(c, category_prefixes)).alias("categories")))
    redirects = rows.where("namespace = 10 AND redirect IS NOT NULL").select(db_key(F.col("title"), template_prefixes, first_letter).alias("from_key"), db_key(F.col("redirect"), template_prefixes, first_letter).alias("to_key"))
    used = rows.select(F.col("page_id").alias("from_id"), F.col("namespace").alias("from_namespace"), F.explode("templates").alias("title")).distinct()
    through = used.join(redirects, F.col("title") == F.col("from_key")).select("from_id", "from_namespace", F.col("to_key").alias("title"))
    links = used.union(through).distinct().withColumn("target_id", F.xxhash64("title"))
    below = rows.select("page_id", "namespace", "title", F.explode("categories").alias("parent"))
    kind = F.when(F.col("namespace") == 14, "subcat").otherwise("page")
    categorylinks = below.select("parent", F.when(F.col("namespace") == 14, db_key(F.col("title"), category_prefixes)).otherwise(F.col("title")).alias("child"), kind.alias("kind"), F.when(F.col("namespace") != 14, F.col("page_id")).alias("page_id")).distinct()
    return Wiki(
        links.select(F.col("target_id").alias("lt_id"), F.lit(10).alias("namespace"), "title").distinct(), links.select("from_id", "from_namespace", "target_id"), rows.select("page_id", "namespace", "title", F.col("revision_id").alias("latest_revision")),
        items.select("page_id", F.lit("wikibase_item").alias("name"), F.col("item").alias("value")), categorylinks, claims, subclass, dbname,
    )


def write_dump(pages: DataFrame, path: str) -> None:
    """pages (page_id, namespace, title, redirect, revision_id, text) as files of page elements."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    led = F.when(F.col("redirect").isNotNull(), F.concat(F.lit('<redirect title="'), safe(F.col("redirect")), F.lit('" />'))).otherwise("")
    element = F.concat(
        F.lit("<page><title>"), safe(F.col("title")), F.lit("</title><ns>"), F.col("namespace").cast("string"), F.lit("</ns><id>"), F.col("page_id").cast("string"), F.lit("</id>"), led,
        F.lit("<revision><id>"), F.col("revision_id").cast("string"), F.lit('</id><text xml:space="preserve">'), safe(F.col("text")), F.lit("</text></revision></page>"),
    )
    pages.select(element.alias("value")).write.text(path)
