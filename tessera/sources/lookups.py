"""Lookups that services answered, as joins over tables, and the small readers of JSON and HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import db_key
from tessera.plans.lineage import checkpointed


def with_revisions(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """rows with revision_id and text, null where the page is gone, and a message for these."""
    out = rows.join(revisions, "page_id", "left")
    return out.withColumn("message", F.when(F.col("revision_id").isNull(), "the page no longer exists"))


def link_targets(titles: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """titles (title), redirects (from_title, to_title), pages (title, item) -> title, target, item, state: item, no_item or missing."""
    out = titles.join(redirects, F.col("title") == F.col("from_title"), "left").withColumn("target", F.coalesce("to_title", "title"))
    known = pages.select(F.col("title").alias("_title"), "item", F.lit(True).alias("_there"))
    out = out.join(known, F.col("target") == F.col("_title"), "left")
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("item").isNull(), "no_item").otherwise("item")
    return out.select("title", "target", "item", state.alias("state"))


def file_locations(names: DataFrame, images: DataFrame, on_shared_wiki: bool = False) -> DataFrame:
    """names (name), images (name, repository: shared or local) -> state: shared, local or missing; on the shared wiki itself local is shared."""
    held = images.groupBy("name").agg(F.max(F.col("repository") == "shared").alias("_shared"))
    state = F.when(F.col("_shared").isNull(), "missing").when(F.col("_shared") | F.lit(on_shared_wiki), "shared").otherwise("local")
    return names.join(held, "name", "left").select("name", state.alias("state"))


def last_items(merges: DataFrame) -> DataFrame:
    """merges (from_item, to_item) -> from_item, last_item: where its chain of merges ends; null for chains that end in a circle.

    Pointers are doubled: each round, an item points to where its target pointed, so a chain of n merges takes log2(n) rounds, each a join and a checkpoint. The number of items that
    point to an item which points on falls in every round until all chains have ended; what is left then goes round.
    """
    jumps = checkpointed(merges.where("from_item IS NOT NULL AND to_item IS NOT NULL").groupBy("from_item").agg(F.min("to_item").alias("to_item")))
    left = None
    while True:
        ahead = jumps.select(F.col("from_item").alias("_at"), F.col("to_item").alias("_next"))
        jumps = checkpointed(jumps.join(ahead, F.col("to_item") == F.col("_at"), "left").select("from_item", F.coalesce("_next", "to_item").alias("to_item"), F.col("_at").isNotNull().alias("_on")))
        now = jumps.where("_on").count()
        if now == 0 or now == left:
            return jumps.select("from_item", F.when(~F.col("_on"), F.col("to_item")).alias("last_item"))
        left, jumps = now, jumps.drop("_on")


def current_items(items: DataFrame, merges: DataFrame | None, existing: DataFrame | None) -> DataFrame:
    """items (item), merges (from_item, to_item), existing (item) -> item, current (the last item of its chain of merges), exists. None for merges: there are none; for existing: all items exist."""
    out = items.withColumn("current", F.col("item"))
    if merges is not None:
        last = last_items(merges).select(F.col("from_item").alias("_from"), "last_item")
        out = out.join(last, F.col("item") == F.col("_from"), "left").withColumn("current", F.when(F.col("_from").isNull(), F.col("item")).otherwise(F.col("last_item")))
    if existing is None:
        return out.select("item", "current", F.col("current").isNotNull().alias("exists"))
    known = existing.select(F.col("item").alias("_item")).distinct()
    return out.join(known, F.col("current") == F.col("_item"), "left").select("item", "current", F.col("_item").isNotNull().alias("exists"))


def names_of(items: DataFrame, labels: DataFrame, symbols: DataFrame, languages: list[str]) -> DataFrame:
    """Labels and aliases in the languages, and unit symbols, of the items. labels: item, language, text; symbols: item, text."""
    said = labels.where(F.col("language").isin(*languages)).select("item", "text").unionByName(symbols.select("item", "text"))
    return said.join(items.select("item").distinct(), "item", "left_semi").distinct()


def unit_names(names: DataFrame) -> DataFrame:
    """names (item, text) -> name (as compared), unit: names that mean one unit only."""
    from tessera.functions.numbers import unit_key

    keyed = names.select(unit_key(F.col("text")).alias("name"), F.col("item").alias("unit")).where("name <> ''")
    return keyed.groupBy("name").agg(F.min("unit").alias("unit"), F.max("unit").alias("_most")).where("unit = _most").drop("_most")


def with_labels(rows: DataFrame, labels: DataFrame, column: str, language: str = "en") -> DataFrame:
    """rows with `label` of the item in a column, the id where there is none."""
    named = labels.where(F.col("language") == language).groupBy(F.col("item").alias("_of")).agg(F.min("text").alias("_label"))
    return rows.join(named, F.col(column) == F.col("_of"), "left").withColumn("label", F.coalesce("_label", column)).drop("_of", "_label")


def external_dates(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Another parser's dates (text, language, year, month, day, precision): days, months and years above zero only."""
    good = answers.where("precision >= 9 AND year > 0").select("text", "language", F.struct("year", F.when(F.col("precision") >= 10, F.col("month")).otherwise(0).alias("month"), F.when(F.col("precision") >= 11, F.col("day")).otherwise(0).alias("day")).alias("external"))
    return rows.join(good, ["text", "language"], "left")


SITE = "struct<general:struct<wikiid:string,lang:string>,namespaces:map<string,struct<id:int,name:string,canonical:string,case:string>>,namespacealiases:array<struct<id:int,alias:string>>>"


def site(info: Column) -> Column:
    """struct(dbname, language, namespaces map<int,string>, template_prefixes, file_prefixes, category_prefixes, first_letter) of a site's JSON description."""
    s = F.from_json(info, SITE)
    spaces = F.map_values(s["namespaces"])
    template = F.filter(spaces, lambda n: n["id"] == 10)

    def prefixes(number: int) -> Column:
        own = F.filter(spaces, lambda n: n["id"] == number)
        aliases = F.filter(F.coalesce(s["namespacealiases"], F.array()), lambda a: a["id"] == number)
        return F.array_distinct(F.array_compact(F.flatten(F.array(F.transform(own, lambda n: n["name"]), F.transform(own, lambda n: n["canonical"]), F.transform(aliases, lambda a: a["alias"])))))

    return F.struct(
        s["general"]["wikiid"].alias("dbname"), s["general"]["lang"].alias("language"), F.map_from_entries(F.transform(spaces, lambda n: F.struct(n["id"], n["name"]))).alias("namespaces"),
        *(prefixes(k).alias(f"{n}_prefixes") for n, k in (("template", 10), ("file", 6), ("category", 14))), F.coalesce(F.get(template, F.lit(0))["case"], F.lit("first-letter")).eqNullSafe("first-letter").alias("first_letter"),
    )


def table_rows(html: Column, pattern: str, groups: int) -> Column:
    """array<struct<c1, c2, ...>> of the pattern's groups, one per match."""
    return F.arrays_zip(*(F.regexp_extract_all(html, F.lit(pattern), F.lit(i + 1)).alias(f"c{i + 1}") for i in range(groups)))


def json_pairs(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, key, value) of a JSON object: lists give a pair per element, what is no text is written as JSON."""
    parsed = rows.select(id_col, F.explode(F.from_json(json_col, "map<string,variant>")).alias("key", "_v"))
    items = F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    shown = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v)))
    return parsed.select(id_col, "key", F.explode(shown).alias("value"))


# Answers after which no edit of this user can succeed.
FATAL = ("blocked", "autoblocked", "permissiondenied", "readonly")


def edit_outcome(code: Column, lag_seconds: Column) -> Column:
    """struct(class, wait) of an edit's answer: done, busy (try again after a wait, in seconds), fatal (stops the run), rejected (this row only)."""
    lag = F.least(F.greatest(F.coalesce(lag_seconds.cast("double"), F.lit(5.0)), F.lit(5.0)), F.lit(60.0)).cast("int")
    kind = F.when(code.isNull(), "done").when(code.isin("maxlag", "ratelimited"), "busy").when(code.isin(*FATAL), "fatal").otherwise("rejected")
    return F.struct(kind.alias("class"), F.when(code == "maxlag", lag).when(code == "ratelimited", 60).alias("wait"))


# Projects that a run may read.
PROJECTS = ("wikipedia", "wikibooks", "wikinews", "wikiquote", "wikisource", "wikiversity", "wikivoyage", "wiktionary", "commons", "species")


def host_for(siteid: str, project: str) -> str:
    """Host of a wiki; ValueError for projects that aren't known and for what is no language code."""
    if project not in PROJECTS:
        raise ValueError(f"unknown project '{project}'")
    if project in ("commons", "species"):
        return f"{project}.wikimedia.org"
    if not re.fullmatch(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*", siteid):
        raise ValueError(f"invalid wiki language code '{siteid}'")
    return f"{siteid}.{project}.org"


def host_of(siteid: Column, project: Column) -> Column:
    """host_for() of columns; null for projects that aren't known and for what is no language code."""
    own = project.isin("commons", "species")
    fine = siteid.rlike(r"^[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z") & project.isin(*PROJECTS)
    return F.when(own, F.concat(project, F.lit(".wikimedia.org"))).when(fine, F.concat(siteid, F.lit("."), project, F.lit(".org")))


def template_redirects(template: str, redirects: DataFrame, templates: DataFrame | None = None, prefixes: tuple[str, ...] = (), first_letter: bool = True) -> list[str] | None:
    """Names that redirect to a template, sorted; None if it doesn't exist. A template has a few dozen of them."""
    shown = lambda c: F.replace(db_key(c, prefixes, first_letter), F.lit("_"), F.lit(" "))
    name, wanted = lambda c: shown(F.col(c)), shown(F.lit(template))
    if templates is not None and templates.where(name("title") == wanted).isEmpty():
        return None
    found = redirects.where(name("to_title") == wanted).select(name("from_title").alias("name")).distinct()
    return [r["name"] for r in found.orderBy("name").collect()]


def editions(claims: DataFrame) -> DataFrame:
    """dbname, item: the item of each wiki by its database name (the least, if there are several)."""
    named = claims.where((F.col("property") == "P1800") & (F.col("rank") != "deprecated"))
    return named.groupBy(F.col("text_value").alias("dbname")).agg(F.min("item").alias("item"))


def edition(claims: DataFrame, dbname: str) -> str | None:
    """The item of a wiki, by its database name."""
    found = editions(claims.where(F.col("text_value") == dbname)).first()
    return None if found is None else found["item"]


def user_items(spark: SparkSession, sql: str) -> DataFrame:
    """Items that a user's own query gives, in its column `item`; what is no item id is left out."""
    if not re.search(r"\bitem\b", sql):
        raise ValueError("the query must give a column item")
    return spark.sql(sql).select(F.col("item").cast("string").alias("item")).where(F.col("item").rlike(r"^Q[0-9]+\z")).distinct()


def saved_query(pages: DataFrame, wiki: str, dbname: str) -> tuple[DataFrame | None, DataFrame | None]:
    """pages (page_id, namespace, title) of a saved query on `wiki` -> (page ids, None) for our own wiki, (None, items) for the repository."""
    if wiki == dbname:
        return pages.where("page_id > 0").select("page_id").distinct(), None
    if wiki == "wikidatawiki":
        return None, pages.where("namespace = 0").select(F.replace("title", F.lit("_"), F.lit(" ")).alias("item")).distinct()
    raise ValueError(f"the saved query lists pages on {wiki}, not on {dbname}")


def items_by_type(claims: DataFrame, items: DataFrame, types: list[str]) -> DataFrame:
    """type, items (sorted): which of the items are instances of each of the types."""
    typed = claims.where((F.col("property") == "P31") & F.col("item_value").isin(*types)).join(items.select("item").distinct(), "item", "left_semi")
    return typed.groupBy(F.col("item_value").alias("type")).agg(F.array_sort(F.collect_set("item")).alias("items"))


def sitelinks(links: DataFrame, items: DataFrame) -> DataFrame:
    """links (item, dbname, title, url) of the items."""
    return links.join(items.select("item").distinct(), "item", "left_semi").select("item", "dbname", "title", "url")


def on_other_wikis(links: DataFrame, project: str) -> DataFrame:
    """links (title, url) -> siteid, title, host of those on a host that we would build for the project, by site id."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    code = F.regexp_extract(host, rf"^([a-z][a-z0-9]*(?:-[a-z0-9]+)*)\.{re.escape(project)}\.org\z", 1)
    return links.withColumn("siteid", code).withColumn("host", host).where("siteid <> ''").select("siteid", "title", "host").orderBy("siteid")


def strictest_status(definitions: DataFrame) -> DataFrame:
    """definitions (property, kind, status, position) -> the strictest status per kind, in the order of first appearance."""
    rank = F.when(F.col("status") == "mandatory", 2).when(F.col("status") == "normal", 1).otherwise(0)
    out = definitions.groupBy("property", "kind").agg(F.max(rank).alias("r"), F.min("position").alias("position"))
    return out.select("property", "kind", F.element_at(F.array(F.lit("suggestion"), F.lit("normal"), F.lit("mandatory")), F.col("r") + 1).alias("status"), "position")


def latest_per(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
