"""Queries over the driver's tables, one or more for every operator, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions import wikitext as W
from tessera.operators import closure, constraints, existing
from tessera.operators.claims import properties_of
from tessera.plans import candidates, properties, results
from tessera.plans.evaluate import Catalog, evaluate
from tessera.plans.job import JobSpec, from_query
from tessera.sources import lookups
from tessera.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def _pages(spark: SparkSession, d: str, brand: str = "Brand#11") -> DataFrame:
    return candidates.transclusions(view(spark, d, "fx_linktarget"), view(spark, d, "fx_templatelinks"), view(spark, d, "fx_page"), view(spark, d, "fx_page_props"), brand)


def _all_pages(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_page").select("page_id", "title", "item", "latest_revision")


# scans and candidates


@query("""SELECT p.page_id, p.title, pp.value AS item, p.latest_revision FROM fx_linktarget t JOIN fx_templatelinks l ON l.target_id = t.lt_id
    JOIN fx_page p ON p.page_id = l.from_id LEFT JOIN fx_page_props pp ON pp.page_id = p.page_id AND pp.name = 'wikibase_item'
    WHERE t.namespace = 10 AND t.title = 'Brand#11' AND l.from_namespace = 0 AND p.namespace = 0""")
def transclusion_scan(spark, d):
    return candidates.newest_first(_pages(spark, d))


@query("SELECT count(*) > 10 AS over_limit FROM fx_page WHERE brand = 'Brand#11'")
def transclusion_limit_check(spark, d):
    return candidates.newest_first(_pages(spark, d)).limit(11).agg((F.count("*") > 10).alias("over_limit"))


_BFS = """WITH RECURSIVE reach AS (SELECT 'R1' AS node, 0 AS level UNION SELECT c.child, r.level + 1 FROM reach r JOIN fx_categorylinks c ON c.parent = r.node AND c.kind = 'subcat' WHERE r.level < {depth})
    SELECT DISTINCT c.page_id FROM reach r JOIN fx_categorylinks c ON c.parent = r.node AND c.kind = 'page'"""


def _category(spark, d, depth):
    return closure.category_members(spark.createDataFrame([("R1",)], "node string"), view(spark, d, "fx_categorylinks"), depth)


@query("SELECT DISTINCT page_id FROM fx_categorylinks WHERE parent IN ('N1', 'N3') AND kind = 'page'")
def category_members_depth0(spark, d):
    return closure.category_members(spark.createDataFrame([("N1",), ("N3",)], "node string"), view(spark, d, "fx_categorylinks"), 0)


@query(_BFS.format(depth=1))
def category_members_depth1(spark, d):
    return _category(spark, d, 1)


@query(_BFS.format(depth=4))
def category_members_cycle(spark, d):
    return _category(spark, d, 4)


@query("""WITH RECURSIVE down AS (SELECT 'root' AS node UNION SELECT s.child FROM down JOIN fx_subclass s ON s.parent = down.node)
    SELECT node FROM down""")
def subclass_closure(spark, d):
    edges = view(spark, d, "fx_subclass").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    return closure.closure(spark.createDataFrame([("root",)], "node string"), edges).select("node")


_IN_CLASS = """SELECT DISTINCT p.item FROM fx_page p WHERE p.item IS NOT NULL AND p.kind IN (SELECT min(p_type) FROM part)"""


def _class_items(spark, d):
    page = view(spark, d, "fx_page")
    kind = page.agg(F.min("kind")).first()[0]
    typed = page.where("item IS NOT NULL").select("item", F.lit("P31").alias("property"), F.col("brand").alias("item_value"))
    typed = typed.unionByName(page.where("item IS NOT NULL").select("item", F.lit("P279").alias("property"), F.col("kind").alias("item_value")))
    return closure.in_classes(page.where("item IS NOT NULL").select("item"), typed, view(spark, d, "fx_subclass"), [kind], ("P279",)).distinct()


@query(_IN_CLASS)
def class_closure_filter(spark, d):
    return _class_items(spark, d)


@query("""WITH RECURSIVE down AS (SELECT min(p_type) AS node FROM part UNION SELECT s.child FROM down JOIN fx_subclass s ON s.parent = down.node)
    SELECT DISTINCT p.item FROM fx_page p JOIN down ON down.node = p.brand WHERE p.item IS NOT NULL""")
def class_closure_two_levels(spark, d):
    page = view(spark, d, "fx_page")
    kind = page.agg(F.min("kind")).first()[0]
    typed = page.where("item IS NOT NULL").select("item", F.lit("P31").alias("property"), F.col("brand").alias("item_value"))
    return closure.in_classes(page.where("item IS NOT NULL").select("item"), typed, view(spark, d, "fx_subclass"), [kind]).distinct()


def _filters(spark, d):
    claims = view(spark, d, "fx_claims")
    part = spark.read.parquet(f"{d}/part.parquet")
    return candidates.Filters(
        category=part.where("p_size <= 40").select(F.col("p_partkey").alias("page_id")),
        saved_pages=part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("page_id")),
        query_items=part.where("p_partkey % 11 <> 0").select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item")),
        class_items=_class_items(spark, d),
        set_items=claims.where("property = 'P1'").select("item"),
    )


_CASCADE = f"""SELECT p.page_id, CASE WHEN p.page_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) THEN 'not_in_category'
    WHEN p.page_id % 7 = 0 THEN 'not_in_saved_query' WHEN p.item IS NULL OR p.page_id % 11 = 0 THEN 'not_in_query' WHEN p.item IS NULL THEN 'no_item'
    WHEN p.item NOT IN ({_IN_CLASS}) THEN 'not_in_class' WHEN p.item IN (SELECT item FROM fx_claims WHERE property = 'P1') THEN 'already_set' END AS reason FROM fx_page p"""


@query(f"SELECT page_id FROM ({_CASCADE}) WHERE reason IS NULL")
def candidate_filter_cascade(spark, d):
    return candidates.cascade(_all_pages(spark, d), _filters(spark, d)).where("reason IS NULL").select("page_id")


@query(f"SELECT reason, count(*) AS n FROM ({_CASCADE}) WHERE reason IS NOT NULL GROUP BY reason")
def exclusion_reasons(spark, d):
    return candidates.excluded(candidates.cascade(_all_pages(spark, d), _filters(spark, d)))


@query("SELECT page_id, title FROM fx_page WHERE title IN (SELECT min(title) FROM fx_page) OR item IN ('Q1', 'Q7', 'Q12')")
def manual_list_filter(spark, d):
    pages = _all_pages(spark, d)
    first = pages.agg(F.min("title")).first()[0]
    return candidates.cascade(pages.where("item IS NOT NULL OR title = '" + first.replace("'", "''") + "'"), candidates.Filters(manual=[first, "Q1", "Q7", "Q12"])).where("reason IS NULL OR reason = 'no_item'").select("page_id", "title")


@query("SELECT page_id FROM fx_page WHERE item IN (SELECT concat('Q', CAST(c_custkey AS STRING)) FROM customer WHERE c_acctbal > 5000)")
def saved_query_filter(spark, d):
    saved = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 5000").select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("item"))
    return candidates.cascade(_all_pages(spark, d), candidates.Filters(saved_items=saved)).where("reason IS NULL").select("page_id")


@query("SELECT page_id FROM fx_page p WHERE item IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = p.item AND c.property = 'P1')")
def already_set_antijoin(spark, d):
    return candidates.cascade(_all_pages(spark, d), candidates.Filters(set_items=view(spark, d, "fx_claims").where("property = 'P1'").select("item"))).where("reason IS NULL").select("page_id")


@query("""SELECT page_id, field, CAST(row_number() OVER (ORDER BY latest_revision DESC, page_id, field) - 1 AS BIGINT) AS seq
    FROM fx_page, (SELECT unnest([0, 1, 2])::INT AS field)""")
def row_numbering(spark, d):
    return candidates.numbered_rows(_all_pages(spark, d), 3, 1, 5_000).select("page_id", "field", F.col("seq").cast("bigint").alias("seq"))


# wikitext: markup is rendered from columns, and what is read back must be the columns


def _rendered(spark, d, pattern: str, **columns):
    """part rows with `wikitext`; %name% places are filled with columns."""
    part = spark.read.parquet(f"{d}/part.parquet").withColumns({k: F.expr(v) for k, v in columns.items()})
    pieces = [F.col(x) if i % 2 else F.lit(x) for i, x in enumerate(pattern.split("%")) if x or i % 2]
    return part.withColumn("wikitext", F.concat(*(p.cast("string") for p in pieces)))


_BOX = "Intro {{Other|x=1}}\n{{infobox_part\n | name = %p_name%\n | brand = [[%p_brand%|the brand]]\n | size=%p_size%\n | %p_type%\n}}\nMore text."


@query("SELECT p_partkey, p_name AS name, concat('[[', p_brand, '|the brand]]') AS brand, CAST(p_size AS STRING) AS size, p_type AS unnamed FROM part")
def template_params_named(spark, d):
    p = W.template_params(F.col("wikitext"), ["Infobox part"])
    rows = _rendered(spark, d, _BOX).select("p_partkey", p.alias("p"))
    return rows.select("p_partkey", *(W.first_of(F.col("p"), [n]).alias(a) for n, a in (("name", "name"), ("brand", "brand"), ("size", "size"), ("1", "unnamed"))))


@query("SELECT p_partkey, p_name AS value FROM part")
def template_params_nested(spark, d):
    rows = _rendered(spark, d, "{{Outer|a={{Inner|%p_name%}}|b=[[x|y]]}}")
    return rows.select("p_partkey", W.first_of(W.template_params(F.col("wikitext"), ["Inner"]), ["1"]).alias("value"))


@query("SELECT p_partkey, p_type AS value FROM part")
def template_params_duplicate(spark, d):
    rows = _rendered(spark, d, "{{X|a=%p_name%|b=|a=%p_type%}}")
    return rows.select("p_partkey", W.first_of(W.template_params(F.col("wikitext"), ["X"]), ["b", "a"]).alias("value"))


@query("SELECT p_partkey, p_brand AS value FROM part")
def template_params_redirect(spark, d):
    rows = _rendered(spark, d, "{{Axle list|wrong}} {{ Template : axle |%p_brand%}}")
    return rows.select("p_partkey", W.first_of(W.template_params(F.col("wikitext"), ["Wheel", "Axle"]), ["1"]).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS value FROM part")
def template_comments_and_refs(spark, d):
    rows = _rendered(spark, d, "<!-- {{X|id=no}} -->%call%<ref>{{X|id=cite}}</ref>", call="CASE WHEN p_partkey % 2 = 0 THEN concat('{{X|id=<ref name=\"a\"/>', p_name, '}}') ELSE '{{X|id=lost' END")
    return rows.select("p_partkey", W.first_of(W.template_params(F.col("wikitext"), ["X"]), ["id"]).alias("value"))


@query("SELECT p_partkey, concat('[[', p_brand, ']] ', p_type) AS value FROM part")
def clean_value(spark, d):
    rows = _rendered(spark, d, "{{icon|x}} [[%p_brand%|label]]&nbsp;'''%p_type%''' {{!}} rest")
    return rows.select("p_partkey", W.clean_value(F.col("wikitext")).alias("value"))


@query("SELECT p_partkey, p_brand AS value FROM part")
def clean_value_unwrapped(spark, d):
    rows = _rendered(spark, d, "{{link|1=no|{{small|%p_brand%}}}}")
    return rows.select("p_partkey", W.clean_value(F.col("wikitext"), unwrap=True).alias("value"))


@query("SELECT p_partkey, '' AS value FROM part")
def clean_value_punctuation(spark, d):
    return _rendered(spark, d, "{{code|%p_name%}}; {{code|%p_brand%}}").select("p_partkey", W.clean_value(F.col("wikitext")).alias("value"))


@query("SELECT p_partkey, concat(p_name, chr(10)) AS lead FROM part")
def lead_section(spark, d):
    return _rendered(spark, d, "%p_name%\n== %p_brand% ==\ntext\n=== x ===\n").select("p_partkey", W.lead_section(F.col("wikitext")).alias("lead"))


@query("SELECT p_partkey, concat(p_brand, '-', CAST(p_size AS STRING)) AS value FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 3 = 0")
def value_pattern(spark, d):
    rows = _rendered(spark, d, "{{X|a=%p_brand%|b=%b%}}", b="CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS STRING) END")
    return rows.select("p_partkey", W.value_pattern(W.template_params(F.col("wikitext"), ["X"]), "{a}-{b}").alias("value"))


# text functions


@query("SELECT p_partkey, concat('x', substring(p_brand, 7), '-y') AS affixed, regexp_replace(p_name, '([a-z])([a-z])', '\\2\\1', 'g') AS swapped, upper(p_name) AS upper FROM part")
def transform_text(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    tail = F.substr(F.col("p_brand"), F.lit(7))
    return part.select("p_partkey", T.transform(tail, add_prefix="abx", add_suffix="-yz", cut_prefix="ab", cut_suffix="z").alias("affixed"), T.transform(F.col("p_name"), search="([a-z])([a-z])", replacement="$2$1").alias("swapped"), T.transform(F.col("p_name"), case="upper").alias("upper"))


@query("SELECT o_orderkey, CAST(o_orderkey AS STRING) AS arabic, CAST(o_custkey AS STRING) AS fullwidth FROM orders")
def ascii_digits(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", T.to_ascii_digits(F.translate(F.col("o_orderkey").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")).alias("arabic"), T.to_ascii_digits(F.translate(F.col("o_custkey").cast("string"), "0123456789", "０１２３４５６７８９")).alias("fullwidth"))


@query("SELECT p_partkey, p_name AS first, p_type AS last, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS plain FROM part")
def link_targets(spark, d):
    rows = _rendered(spark, d, "see [[%p_name%|a]] and [[ %p_type% ]]", bare="CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE concat('[[', p_name, '#s]]') END")
    return rows.select("p_partkey", T.link_target(F.col("wikitext")).alias("first"), T.link_target(F.col("wikitext"), last=True).alias("last"), T.link_target(F.col("bare"), allow_plain=True).alias("plain"))


@query("SELECT p_partkey, concat('Part ', CAST(p_partkey AS STRING), '+a (1).jpg') AS name FROM part")
def file_names(spark, d):
    rows = _rendered(spark, d, "[[file: part_%p_partkey%+a%lt%(1).jpg|300px]]", lt="'%20'")
    return rows.select("p_partkey", T.file_name(F.col("wikitext")).alias("name"))


@query("""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages""")
def url_extract(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    found = T.url(F.concat(F.lit("["), F.col("url"), F.lit(" label]")))
    return pages.select("page_id", found.alias("url"), T.host(found).alias("host"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN NULL ELSE url END AS value,
    CASE WHEN page_id % 3 = 1 THEN 'an archived copy without the original URL' END AS rejection FROM pages""")
def archive_policy(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://web.archive.org/web/20150101000000/"), "url")).when(F.col("page_id") % 3 == 1, F.lit("https://archive.is/abc")).otherwise(F.col("url"))
    return pages.select("page_id", T.web_url(address, "original").alias("u")).select("page_id", "u.value", "u.rejection")


@query("SELECT n_nationkey, concat('https://x.org/w/index.php?title=', replace(n_name, ' ', '_'), '_(a/b)&oldid=', CAST(n_nationkey AS STRING)) AS link FROM nation")
def permalinks(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    return n.select("n_nationkey", T.permalink(F.lit("x.org"), F.concat("n_name", F.lit(" (a/b)")), F.col("n_nationkey")).alias("link"))


# numbers, dates, coordinates


@query("""SELECT o_orderkey, concat('+', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)) AS amount, 'kg' AS unit_key FROM orders""")
def amounts_and_units(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(F.format_number(F.floor("o_totalprice"), 0), F.lit(" [[Kilogram|Kg.]]"))
    part = o.select("o_orderkey", N.split_unit(text).alias("s"))
    return part.select("o_orderkey", N.amount(F.col("s.number")).alias("amount"), N.unit_key(F.col("s.unit")).alias("unit_key"))


@query("""WITH u AS (SELECT lower(concat(p_brand, ' ', CAST(p_size AS STRING))) AS name, p_type AS unit FROM part)
    SELECT name, min(unit) AS unit FROM u GROUP BY name HAVING count(DISTINCT unit) = 1""")
def unambiguous_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return lookups.unit_names(part.select(F.col("p_type").alias("item"), F.concat(F.lit("[[x|"), "p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit(".]]")).alias("text")))


_DAYS = "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders"


def _dates(spark, d, text, months=None):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), "o_orderdate")
    return o.select("o_orderkey", N.parse_date(text, months).alias("d")).select("o_orderkey", "d.date.year", "d.date.month", "d.date.day")


@query(_DAYS)
def date_iso(spark, d):
    return _dates(spark, d, F.concat(F.lit("born "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" there")))


@query(_DAYS)
def date_numeric_dmy(spark, d):
    return _dates(spark, d, F.date_format("o_orderdate", "d.M.yyyy"))


@query(_DAYS)
def date_cjk(spark, d):
    return _dates(spark, d, F.translate(F.date_format("o_orderdate", "yyyy'年'M'月'd'日'"), "0123456789", "０１２３４５６７８９"))


@query(_DAYS)
def date_day_month_name(spark, d):
    return _dates(spark, d, F.date_format("o_orderdate", "d MMMM yyyy"), N.abbreviated(N.ENGLISH))


@query(_DAYS)
def date_month_name_day(spark, d):
    return _dates(spark, d, F.date_format("o_orderdate", "MMM d, yyyy"), N.abbreviated(N.ENGLISH))


@query(f"SELECT o_orderkey, year, month, 0 AS day FROM ({_DAYS})")
def date_month_year(spark, d):
    return _dates(spark, d, F.date_format("o_orderdate", "'in' MMMM yyyy"), N.abbreviated(N.ENGLISH))


@query(f"SELECT o_orderkey, year, 0 AS month, 0 AS day FROM ({_DAYS})")
def date_year_only(spark, d):
    return _dates(spark, d, F.date_format("o_orderdate", "'the year' yyyy, yyyy"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'imprecise date' WHEN o_orderkey % 3 = 1 THEN 'ambiguous date: several years' ELSE 'invalid date' END AS error FROM ({_DAYS})""")
def date_errors(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'circa' yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "'from' yyyy 'to 2050'")).otherwise(F.date_format("o_orderdate", "yyyy'-13-'dd"))
    return o.select("o_orderkey", N.parse_date(text)["error"].alias("error"))


@query(_DAYS)
def date_parts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    roman = F.element_at(F.array(*map(F.lit, N.ROMAN)), F.month("o_orderdate"))
    date = N.date_from_parts(F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, roman).otherwise(F.month("o_orderdate").cast("string")), F.dayofmonth("o_orderdate").cast("string"))
    return o.select("o_orderkey", date.alias("d")).select("o_orderkey", "d.year", "d.month", "d.day")


@query(f"SELECT o_orderkey, strftime(make_date(year, month, day), '+%Y-%m-%dT00:00:00Z') AS wire, 11 AS precision FROM ({_DAYS})")
def date_wire_form(spark, d):
    dates = _dates(spark, d, F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("d", F.struct("year", "month", "day"))
    return dates.select("o_orderkey", N.wire_time(F.col("d")).alias("wire"), N.precision(F.col("d")).alias("precision"))


@query(f"SELECT o_orderkey FROM ({_DAYS}) WHERE CASE WHEN o_orderkey % 2 = 0 THEN year * 100 + month < 199807 ELSE year < 1998 END")
def date_limit_filter(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    month = F.when(F.col("o_orderkey") % 2 == 0, F.month("o_orderdate")).otherwise(0)
    date = F.struct(F.year("o_orderdate").alias("year"), month.alias("month"), F.lit(0).alias("day"))
    return o.where(N.within_limit(date, (1998, 7, 1), at_least=False)).select("o_orderkey")


_PLACES = "SELECT p_partkey, round(CAST(p_partkey % 90 AS DOUBLE) + CAST(p_partkey % 60 AS DOUBLE) / 60, 6) AS latitude, round(0 - (CAST(p_partkey % 180 AS DOUBLE) + CAST(p_partkey % 59 AS DOUBLE) / 60), 6) AS longitude, round(CAST(1 AS DOUBLE) / 60, 6) AS precision FROM part"


def _rounded(rows, c):
    return rows.select("p_partkey", c.alias("c")).select("p_partkey", F.round("c.latitude", 6).alias("latitude"), (F.round("c.longitude", 6) + F.lit(0.0)).alias("longitude"), F.round("c.precision", 6).alias("precision"))


@query(_PLACES)
def coordinate_degrees(spark, d):
    text = F.format_string("%d° %d′ N, %d° %d′ W", F.col("p_partkey") % 90, F.col("p_partkey") % 60, F.col("p_partkey") % 180, F.col("p_partkey") % 59)
    return _rounded(spark.read.parquet(f"{d}/part.parquet"), N.parse_coordinate(text))


@query(_PLACES)
def coordinate_template(spark, d):
    text = F.format_string("{{coord|%d|%d|N|%d|%d|W|type:city(35)|display=title}}", F.col("p_partkey") % 90, F.col("p_partkey") % 60, F.col("p_partkey") % 180, F.col("p_partkey") % 59)
    return _rounded(spark.read.parquet(f"{d}/part.parquet"), N.parse_coordinate(W.coordinate_params(text)))


@query("SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) + 0.25 AS latitude, -CAST(p_partkey % 180 AS DOUBLE) - 0.5 AS longitude, 0.01 ::DOUBLE AS precision FROM part WHERE p_partkey % 180 < 179")
def coordinate_decimal(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 180 < 179")
    return _rounded(part, N.coordinate_from_parts(F.format_string("%d.25", F.col("p_partkey") % 90), F.format_string("-%d.5", F.col("p_partkey") % 180)))


# values against existing ones


def _new_rows(spark, d):
    """One candidate row per order: its customer's item, the next property, and its own value: a text, an item, an amount or a date."""
    c, kind = view(spark, d, "fx_claims"), F.col("claim_id") % 6
    prop = F.concat(F.lit("P"), (F.substring("property", 2, 1).cast("int") % 5 + 1).cast("string"))
    date = F.struct("year", F.when(F.col("claim_id") % 2 == 0, F.col("month")).otherwise(0).alias("month"), F.lit(0).alias("day"))
    used = F.when(F.col("claim_id") % 3 == 0, F.array(F.lit("P580"))).when(F.col("claim_id") % 3 == 1, F.array(F.lit("P580"), F.lit("P99"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("claim_id").alias("row_id"), "item", prop.alias("property"), F.when(kind.isin(1, 4), F.col("item_value")).alias("v_item"), F.col("text_value").alias("v_text"),
        F.when(kind == 2, F.round("amount", 1).cast("decimal(20,1)").cast("string")).alias("v_amount"), F.when(kind == 2, F.nullif(F.concat(F.lit("Q"), (F.col("claim_id") % 4).cast("string")), F.lit("Q0"))).alias("v_unit"),
        F.when(kind == 5, date).alias("v_date"), used.alias("used"), "amount", date.alias("date"), F.coalesce(F.concat(F.lit("[["), "item_value", F.lit("]]")), "text_value").alias("value"),
    )


_ROWS = """SELECT claim_id AS row_id, item, concat('P', CAST(CAST(substring(property, 2, 1) AS INT) % 5 + 1 AS STRING)) AS property, CASE WHEN claim_id % 6 IN (1, 4) THEN item_value END AS v_item, text_value AS v_text,
    CASE WHEN claim_id % 6 = 2 THEN CAST(round(amount, 1) AS DECIMAL(20,1)) END AS v_amount, CASE WHEN claim_id % 6 = 2 AND claim_id % 4 > 0 THEN concat('Q', CAST(claim_id % 4 AS STRING)) END AS v_unit,
    CASE WHEN claim_id % 6 = 5 THEN year END AS v_year, CASE WHEN claim_id % 6 = 5 THEN CASE WHEN claim_id % 2 = 0 THEN month ELSE 0 END END AS v_month, claim_id % 3 AS used,
    amount, year, CASE WHEN claim_id % 2 = 0 THEN month ELSE 0 END AS month, coalesce('[[' || item_value || ']]', text_value) AS value FROM fx_claims"""


@query(f"""WITH r AS ({_ROWS}), m AS (SELECT r.row_id, bool_or(c.rank <> 'deprecated' AND c.year = r.year AND (r.month = 0 OR c.month = r.month)) AS hit FROM r JOIN fx_claims c ON c.item = r.item AND c.property = r.property GROUP BY r.row_id)
    SELECT r.row_id, CASE WHEN hit THEN 'the item already has this value' WHEN hit IS NOT NULL THEN 'the item already has the property' END AS skip FROM r LEFT JOIN m ON m.row_id = r.row_id""")
def value_matches_date(spark, d):
    other = F.struct(F.col("c_year").alias("year"), F.col("c_month").alias("month"), F.col("c_day").alias("day"))
    return existing.already_there(_new_rows(spark, d), view(spark, d, "fx_claims"), N.same_date(F.col("date"), other), any_value=True).select("row_id", "skip")


@query(f"""WITH r AS ({_ROWS}) SELECT r.row_id, max(CASE WHEN c.rank <> 'deprecated' AND round(c.amount, -3) = round(r.amount, -3) THEN 'the item already has this value' END) AS skip
    FROM r LEFT JOIN fx_claims c ON c.item = r.item AND c.property = r.property GROUP BY r.row_id""")
def value_matches_quantity(spark, d):
    rough = lambda c: F.round(c, -3)
    return existing.already_there(_new_rows(spark, d), view(spark, d, "fx_claims"), N.same_amount(rough(F.col("amount")), rough(F.col("c_amount")))).select("row_id", "skip")


@query(f"""WITH r AS ({_ROWS}) SELECT r.row_id, max(CASE WHEN c.rank <> 'deprecated' AND abs(r.amount / 1000 - c.amount / 1000) <= 5 AND abs(r.month - c.month) <= 5 THEN 'the item already has this value' END) AS skip
    FROM r LEFT JOIN fx_claims c ON c.item = r.item AND c.property = r.property GROUP BY r.row_id""")
def value_matches_coordinate(spark, d):
    same = N.same_coordinate(F.col("amount") / 1000, F.col("date.month"), F.col("c_amount") / 1000, F.col("c_month"), F.lit(5.0))
    return existing.already_there(_new_rows(spark, d), view(spark, d, "fx_claims"), same).select("row_id", "skip")


@query(f"""WITH r AS ({_ROWS}) SELECT r.row_id, max(CASE WHEN c.rank <> 'deprecated' AND (c.text_value = r.v_text OR c.item_value = r.v_item) THEN 'the item already has this value' END) AS skip
    FROM r LEFT JOIN fx_claims c ON c.item = r.item AND c.property = 'P3' GROUP BY r.row_id""")
def value_matches_text_or_item(spark, d):
    same = F.coalesce(F.col("v_text") == F.col("c_text_value"), F.col("v_item") == F.col("c_item_value"))
    rows = view(spark, d, "fx_claims").select(F.col("claim_id").alias("row_id"), "item", F.lit("P3").alias("property"), F.when((F.col("claim_id") % 6).isin(1, 4), F.col("item_value")).alias("v_item"), F.col("text_value").alias("v_text"))
    return existing.already_there(rows, view(spark, d, "fx_claims"), same).select("row_id", "skip")


@query("""WITH r AS (SELECT claim_id AS row_id, item, property, coalesce('[[' || item_value || ']]', text_value) AS value FROM fx_claims), h AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rev DESC) AS n FROM fx_history)
    SELECT DISTINCT r.row_id FROM r JOIN h ON h.item = r.item AND h.n <= 500 AND contains(h.comment, 'wbremoveclaims-remove')
    AND (contains(h.comment || ' ', 'Property:' || r.property || ']]: ' || r.value || ' ') OR contains(h.comment, 'Property:' || r.property || ']]: ' || r.value || ','))""")
def removed_before(spark, d):
    rows = view(spark, d, "fx_claims").select(F.col("claim_id").alias("row_id"), "item", "property", F.coalesce(F.concat(F.lit("[["), "item_value", F.lit("]]")), "text_value").alias("value"))
    return existing.removed_before(rows, view(spark, d, "fx_history")).select("row_id")


# constraints: every query goes from a definition to the rule that it makes

C = constraints


def _world(spark, d) -> constraints.World:
    page = view(spark, d, "fx_page")
    typed = page.where("item IS NOT NULL").select("item", F.lit("P31").alias("property"), F.col("brand").alias("item_value"))
    pages = page.where("page_id % 2 = 0").select(F.lit("").alias("namespace"), F.concat(F.lit("tt"), F.col("page_id").cast("string")).alias("title"))
    declared = spark.createDataFrame([("P4", "P1", None), ("P5", "P2", "Q31")], "property string, with_property string, with_value string")
    subclass = view(spark, d, "fx_subclass").select("child", F.when(F.col("parent") == "SMALL", "Q900").otherwise(F.col("parent")).alias("parent"))  # a class with an item's id
    return C.World(view(spark, d, "fx_claims"), typed, subclass, pages, declared, datetime.date(1998, 5, 1))


def _violates(name: str, kind: str, sql: str, qualifiers: dict | None = None, **changes) -> None:
    def run(spark, d):
        rows = _new_rows(spark, d)
        known = next(k for k, v in C.NAMES.items() if v == kind)
        rules = C.rules([C.Definition(known, "normal", qualifiers or {})], rows, replace(_world(spark, d), **changes))
        return C.first_violation(rows, rules).where("violation IS NOT NULL").select("row_id", "violation")

    run.__name__ = f"constraint_{name}"
    query(f"WITH r AS ({_ROWS}) SELECT r.row_id, '{kind}' AS violation FROM r {sql}")(run)


_HAS = "EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = {of} AND c.property = {p}{more})"
_BEST = "EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = r.v_item AND c.property = {p}{more} AND c.rank <> 'deprecated' AND (c.rank = 'preferred' OR NOT EXISTS (SELECT 1 FROM fx_claims b WHERE b.item = c.item AND b.property = c.property AND b.rank = 'preferred')))"
_IN = "EXISTS (SELECT 1 FROM fx_page p WHERE p.item = r.{c} AND p.brand IN (SELECT child FROM fx_subclass WHERE parent = 'SMALL'))"


def _has(p: str, more: str = "", of: str = "r.item") -> str:
    return _HAS.format(p=p, more=more, of=of)


_violates("single_value", "single value", "WHERE " + _has("r.property", " AND c.rank <> 'deprecated'"))
_violates("single_best_value", "single best value", "WHERE " + _has("r.property", " AND c.rank = 'normal'") + " AND NOT " + _has("r.property", " AND c.rank = 'preferred'"))
_violates("one_of", "one of", "WHERE v_item NOT IN ('Q1', 'Q31', 'Q62')", {"P2305": ["Q1", "Q31", "Q62"]})
_violates("none_of", "none of", "WHERE v_item IN ('Q1', 'Q31', 'Q62')", {"P2305": ["Q1", "Q31", "Q62"]})
_violates("range_quantity", "range", "WHERE v_amount < 50000 OR v_amount > 200000", {"P2313": ["+50000"], "P2312": ["+200000"]})
_violates("range_date", "range", "WHERE (CASE WHEN v_month = 0 THEN v_year * 100 + 12 ELSE v_year * 100 + v_month END) < 199603 OR v_year > 1999", {"P2310": ["+1996-03-01T00:00:00Z"], "P2311": ["+1999-00-00T00:00:00Z"]})
_violates("range_until_now", "range", "WHERE v_year > 1998 OR (v_year = 1998 AND v_month > 5)", {"P2311": [C.NOW], "P2310": [None]})
_violates("integer", "integer", "WHERE regexp_matches(CAST(v_amount AS VARCHAR), '\\.[0-9]*[1-9]')")
_violates("format", "format", "WHERE NOT regexp_full_match(v_text, 'tt[1-4][0-9]+')", {"P1793": ["tt[1-4](?P<rest>[0-9]+)"]})
_violates("format_letters", "format", "WHERE NOT regexp_full_match(v_text, '[a-zA-Z]+[0-9]+')", {"P1793": [r"\p{L}+[0-9]+"]})
_violates("allowed_units", "allowed units", "WHERE v_amount IS NOT NULL AND coalesce(v_unit, '1') NOT IN ('Q1', '1')", {"P2305": ["Q1", None]})
_violates("allowed_qualifiers", "allowed qualifiers", "WHERE used = 1", {"P2306": ["P580", "P582"]})
_violates("mandatory_qualifier", "mandatory qualifier", "WHERE used = 2", {"P2306": ["P580"]})
_violates("item_requires", "item requires statement", "WHERE NOT " + _has("'P2'"), {"P2306": ["P2"]})
_violates("item_requires_value", "item requires statement", "WHERE NOT " + _has("'P2'", " AND CAST(substring(c.item_value, 2) AS BIGINT) < 500"), {"P2306": ["P2"], "P2305": [f"Q{i}" for i in range(500)]})
_violates("conflicts_with", "conflicts with", "WHERE " + _has("'P3'"), {"P2306": ["P3"]}, conflicts=None)
_violates("declared_conflicts", "conflicts with", "WHERE (r.property = 'P1' AND " + _has("'P4'") + ") OR (r.property = 'P2' AND r.v_item = 'Q31' AND " + _has("'P5'") + ")")
_violates("distinct_values", "distinct values", "WHERE EXISTS (SELECT 1 FROM fx_claims c WHERE c.property = r.property AND (c.item_value = r.v_item OR c.text_value = r.v_text) AND c.item <> r.item)")
_violates("inverse", "inverse", "WHERE v_item IS NOT NULL AND NOT " + _BEST.format(p="'P4'", more=" AND c.item_value = r.item"), {"P2306": ["P4"]})
_violates("symmetric", "symmetric", "WHERE v_item IS NOT NULL AND NOT " + _BEST.format(p="r.property", more=" AND c.item_value = r.item"))
_violates("value_requires", "value requires statement", "WHERE v_item IS NOT NULL AND NOT " + _BEST.format(p="'P2'", more=""), {"P2306": ["P2"]})
_violates("commons_link", "Commons link", "WHERE v_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_page p WHERE p.page_id % 2 = 0 AND concat('tt', CAST(p.page_id AS STRING)) = r.v_text)")
_violates("type", "type", "WHERE NOT " + _IN.format(c="item"), {"P2308": ["Q900"]})
_violates("value_type", "value type", "WHERE v_item IS NOT NULL AND NOT " + _IN.format(c="v_item"), {"P2308": ["Q900"]})


@query(f"""WITH r AS ({_ROWS}), n AS (SELECT count(*) AS n FROM r) SELECT x.name, CASE WHEN x.hit THEN n.n ELSE 0 END AS n FROM n,
    (VALUES ('scope: main value', false), ('scope: references', true), ('scope: none named', false), ('entities: items', false), ('entities: others', true), ('citation', false), ('bounds', false)) AS x(name, hit)""")
def constraint_by_definition(spark, d):
    """Kinds whose outcome the definition alone decides, each with definitions of either outcome."""
    rows, world = _new_rows(spark, d), _world(spark, d)
    tried = {
        "scope: main value": C.Definition("Q53869507", qualifiers={"P5314": ["Q54828448", "Q54828450"]}), "scope: references": C.Definition("Q53869507", qualifiers={"P5314": ["Q54828450"]}), "scope: none named": C.Definition("Q53869507"),
        "entities: items": C.Definition("Q52004125", qualifiers={"P2305": ["Q29934200"]}), "entities: others": C.Definition("Q52004125", qualifiers={"P2305": ["Q51885771"]}), "citation": C.Definition("Q54554025"), "bounds": C.Definition("Q51723761"),
    }
    out = None
    for name, definition in tried.items():
        n = C.first_violation(rows, C.rules([definition], rows, world)).agg(F.lit(name).alias("name"), F.count("violation").alias("n"))
        out = n if out is None else out.union(n)
    return out


@query(f"""WITH r AS ({_ROWS}) SELECT row_id, CASE WHEN v_amount < 50000 THEN 'range' WHEN item NOT IN ('Q7', 'Q8') AND {_has("r.property", " AND c.rank <> 'deprecated'")} THEN 'single value'
    WHEN v_item IN ('Q1', 'Q31') THEN 'none of' END AS violation FROM r""")
def first_violation(spark, d):
    rows = _new_rows(spark, d)
    rules = [C.Definition("Q21510860", "mandatory", {"P2313": ["+50000"]}), C.Definition("Q19474404", "normal", {"P2303": ["Q7", "Q8"]}), C.Definition("Q1", "mandatory"), C.Definition("Q52558054", "normal", {"P2305": ["Q1", "Q31"]}), C.Definition("Q21510859", "suggestion", {"P2305": ["Q5"]}), C.Definition("Q52848401", "normal")]
    chosen = C.selected(rules, ("Q19474404", "Q52558054"))
    return C.first_violation(rows, C.rules(chosen, rows, _world(spark, d))).select("row_id", "violation")


# properties and preparation


@query("""SELECT concat('P', CAST(r_regionkey + 1 AS STRING)) AS id, CASE WHEN r_regionkey % 2 = 0 THEN lower(r_name) ELSE concat('P', CAST(r_regionkey + 1 AS STRING)) END AS label, r_regionkey <> 3 AS supported, r_regionkey = 4 AS deprecated,
    concat('https://x.org/', lower(r_name), '/$1') AS formatter_url, 3 AS n_constraints, 'tt[0-9]+' AS pattern, '+10' AS low, true AS unbounded FROM region""")
def property_info(spark, d):
    p = properties.properties(view(spark, d, "fx_property"))
    q = lambda i, k: F.get(F.try_element_at(F.get("constraints", F.lit(i))["qualifiers"], F.lit(k)), F.lit(0))
    high = F.try_element_at(F.get("constraints", F.lit(1))["qualifiers"], F.lit("P2312"))
    return p.select("id", "label", "supported", "deprecated", "formatter_url", F.size("constraints").alias("n_constraints"), q(0, "P1793").alias("pattern"), q(1, "P2313").alias("low"), ((F.size(high) == 1) & F.get(high, F.lit(0)).isNull()).alias("unbounded"))


@query("""SELECT concat('P', CAST(r_regionkey + 1 AS STRING)) AS property, k.position, k.kind, k.label, k.status, k.known FROM region, (VALUES (0, 'Q21502404', 'pattern', 'mandatory', true), (1, 'Q21510860', 'Q21510860', 'normal', true), (2, 'Q99', 'Q99', 'suggestion', false)) AS k(position, kind, label, status, known)""")
def constraint_list(spark, d):
    labels = spark.createDataFrame([("Q21502404", "en", "pattern"), ("Q99", "de", "anders")], "item string, language string, text string")
    return properties.constraint_list(properties.properties(view(spark, d, "fx_property")), labels)


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN concat('https://www.wikidata.org/wiki/Q', CAST(n_nationkey AS STRING)) WHEN 1 THEN concat('https://commons.wikimedia.org/wiki/File:', n_name, '_a%2Fb.jpg')
    WHEN 2 THEN concat('https://x.org/', n_name, '/', n_name, '%20b') WHEN 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN concat('https://', n_name) END END AS link FROM nation""")
def value_links(spark, d):
    n, k = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey") % 5
    kind = F.when(k == 0, "wikibase-item").when(k == 1, "commonsMedia").when(k == 2, "external-id").when(k == 3, "url").otherwise("time")
    value = F.when(k == 0, F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"), F.lit("; P580: 1999"))).when(k == 1, F.concat("n_name", F.lit(" a/b.jpg"))).when(k == 2, F.concat("n_name", F.lit("/"), "n_name", F.lit(" b"))).when(k == 3, F.concat(F.when(F.col("n_nationkey") % 2 == 0, "https://").otherwise("ftp://"), "n_name")).otherwise("1999")
    return n.select(F.col("n_nationkey").alias("id"), properties.value_link(kind, value, F.lit("https://x.org/$1")).alias("link"))


@query("""SELECT p_partkey AS id, concat('Added [[Property:P1]]: ', CASE WHEN p_partkey % 2 = 0 THEN concat('[[Q', CAST(p_partkey AS STRING), ']]') ELSE substring(repeat(p_name, 12), 1, 100) END, ' from enwiki ([[:toollabs:editgroups/b/tool/abc|details]])') AS summary FROM part""")
def edit_summaries(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    item = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Q"), F.col("p_partkey").cast("string")))
    return part.select(F.col("p_partkey").alias("id"), properties.edit_summary(F.lit("P1"), item, F.repeat("p_name", 12), F.lit("enwiki"), F.lit("abc"), "tool").alias("summary"))


# results


@query("""SELECT run_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'done') AS done,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status NOT IN ('pending', 'ready', 'done', 'skipped')) AS error, count(*) AS total,
    CAST(round(100.0 * count(*) FILTER (status NOT IN ('pending', 'ready')) / count(*), 0) AS INT) AS percent FROM fx_run_row GROUP BY run_id""")
def run_counts(spark, d):
    return results.counts(view(spark, d, "fx_run_row"))


@query("SELECT seq, status FROM fx_run_row WHERE run_id = (SELECT min(user_id) FROM events) AND status = 'pending' ORDER BY seq LIMIT 10 OFFSET 5")
def rows_page(spark, d):
    rows = view(spark, d, "fx_run_row")
    return results.page_of(rows, rows.agg(F.min("run_id")).first()[0], "pending", 5, 10).select("seq", "status")


@query("SELECT seq, status FROM fx_run_row WHERE run_id = (SELECT min(user_id) FROM events) AND status IN ('pending', 'ready') AND seq > 100 ORDER BY seq LIMIT 50")
def rows_keyset(spark, d):
    rows = view(spark, d, "fx_run_row")
    return results.next_rows(rows, rows.agg(F.min("run_id")).first()[0], ["pending", "ready"], 100).select("seq", "status")


@query("SELECT id, status FROM fx_run WHERE user_id = 3 ORDER BY id DESC LIMIT 10")
def runs_latest(spark, d):
    return results.latest_runs(view(spark, d, "fx_run"), 3, 10).select("id", "status")


@query("""WITH c AS (SELECT *, CASE id % 4 WHEN 0 THEN 'editing' WHEN 1 THEN 'done' WHEN 2 THEN 'ready' ELSE 'failed' END AS wanted FROM fx_run),
    m AS (SELECT *, id % 3 > 0 AND (CASE status WHEN 'loading' THEN wanted IN ('ready', 'failed') WHEN 'editing' THEN wanted IN ('done', 'failed') ELSE wanted = 'editing' END) AS moved FROM c)
    SELECT id, CASE WHEN moved THEN wanted ELSE status END AS status, CASE WHEN moved THEN 'so' END AS message, CASE WHEN moved AND wanted = 'editing' THEN coalesce(started, 77) ELSE started END AS started,
    CASE WHEN NOT moved THEN finished WHEN wanted IN ('done', 'failed') THEN 77 END AS finished FROM m""")
def run_status_changes(spark, d):
    runs = view(spark, d, "fx_run")
    to = F.element_at(F.array(*map(F.lit, ("editing", "done", "ready", "failed"))), (F.col("id") % 4 + 1).cast("int"))
    changes = runs.where("id % 3 > 0").select("id", to.alias("status"), F.lit("so").alias("message"), F.lit(77).cast("bigint").alias("at"))
    return results.runs_changed(runs, changes).select("id", "status", "message", "started", "finished")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'preview' ELSE 'edit' END AS phase, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'other' END AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counters(spark, d):
    return results.status_counts(view(spark, d, "fx_run_row"), F.when(F.col("seq") % 2 == 0, "preview").otherwise("edit"))


@query("SELECT row_number() OVER (ORDER BY latest_revision DESC, page_id, field) - 1 AS seq, page_id, field, 'pending' AS status, 9 AS run_id FROM fx_page, (SELECT unnest([0, 1])::INT AS field)")
def run_rows_added(spark, d):
    from tessera.plans.lineage import scratch

    path = scratch(spark, "run-rows")
    results.add_rows(candidates.numbered_rows(_all_pages(spark, d), 2, 9, 5_000), path)
    return spark.read.parquet(path).select(F.col("seq").cast("bigint").alias("seq"), "page_id", "field", "status", "run_id")


@query("SELECT run_id, seq, status FROM (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS before FROM fx_run_row) WHERE before IS NULL OR before <> status")
def consecutive_dedup(spark, d):
    return results.without_repeats(view(spark, d, "fx_run_row"), "run_id", "seq", "status").select("run_id", "seq", "status")


@query("""WITH m AS (SELECT *, sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM fx_run_row),
    s AS (SELECT run_id, island, count(*) AS n FROM m WHERE status = 'error' GROUP BY run_id, island) SELECT run_id, max(n) AS longest FROM s GROUP BY run_id""")
def failure_streak(spark, d):
    return results.failure_streaks(view(spark, d, "fx_run_row"))


@query("SELECT run_id, seq, CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'Q9' ELSE item END AS item, CASE WHEN seq % 3 = 0 THEN 'done' ELSE status END AS status, CASE WHEN seq % 3 = 0 THEN CAST(seq AS DOUBLE) ELSE value END AS value FROM fx_run_row")
def row_update_merge(spark, d):
    rows = view(spark, d, "fx_run_row")
    updates = rows.where("seq % 3 = 0").select("run_id", "seq", F.when(F.col("seq") % 2 == 0, "Q9").alias("item"), F.lit("done").alias("status"), F.col("seq").cast("double").alias("value"))
    return results.merged(rows, updates).select("run_id", "seq", "item", "status", "value")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'failed' WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'paused' ELSE 'done' END AS status FROM events")
def restart_recovery(spark, d):
    states = F.when(F.col("event_type") == "view", "loading").when(F.col("event_type") == "click", "previewing").when(F.col("event_type") == "signup", "editing").otherwise("done")
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", results.recovered(states).alias("status"))


@query("""WITH f AS (SELECT user_id % 25 AS share, event_id AS run_id, event_id AS finished, event_id % 11 AS done, event_id % 5 AS error FROM events WHERE event_type <> 'view'),
    l AS (SELECT share, arg_max(run_id, finished) AS last_run_id, max(finished) AS last_completed, arg_max(done, finished) AS last_done, arg_max(error, finished) AS last_errors FROM f GROUP BY share)
    SELECT s.id, l.last_run_id, l.last_completed, l.last_done, l.last_errors FROM fx_share s LEFT JOIN l ON l.share = s.id""")
def share_outcome(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    runs = e.select((F.col("user_id") % 25).alias("share_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") != "view", F.col("event_id")).alias("finished"), (F.col("event_id") % 11).alias("done"), (F.col("event_id") % 5).alias("error"))
    return results.recorded(view(spark, d, "fx_share"), runs).select("id", "last_run_id", "last_completed", "last_done", "last_errors")


@query("""SELECT 'share' AS what, id, title AS text FROM fx_share WHERE id % 3 <> 0 UNION ALL SELECT 'tag', share_id, tag FROM fx_share_tag WHERE share_id % 3 <> 0""")
def share_deletion(spark, d):
    shares, tags = results.without_shares(view(spark, d, "fx_share"), view(spark, d, "fx_share_tag"), view(spark, d, "fx_share").where("id % 3 = 0").select("id"))
    return shares.select(F.lit("share").alias("what"), "id", F.col("title").alias("text")).union(tags.select(F.lit("tag"), "share_id", "tag"))


@query("""SELECT share_id, tag FROM fx_share_tag WHERE share_id % 4 <> 1 UNION ALL SELECT id, unnest([concat('czech-', lower(title)), 'films']) FROM fx_share WHERE id % 4 = 1""")
def share_retagging(spark, d):
    new = view(spark, d, "fx_share").where("id % 4 = 1").select(F.col("id").alias("share_id"), F.array(F.concat(F.lit("  Czech \u00a0"), "title"), F.lit("films "), F.lit("Films"), F.lit(" ")).alias("tags"))
    return results.retagged(view(spark, d, "fx_share_tag"), new)


_LEGACY = """SELECT 100 + n_nationkey AS legacy_id, 'x' AS user_name, CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE ' ' END AS template, CASE WHEN n_nationkey % 6 > 0 THEN 'P1' END AS property, 'en' AS siteid, 'wikipedia' AS project FROM {nation}"""


@query("""SELECT 25 AS listed, count(*) FILTER (n_nationkey % 4 > 0 AND n_nationkey % 6 > 0 AND n_nationkey % 5 > 0) AS imported, count(*) FILTER (n_nationkey % 4 > 0 AND n_nationkey % 6 > 0 AND n_nationkey % 5 = 0) AS already_there, count(*) FILTER (n_nationkey % 4 = 0 OR n_nationkey % 6 = 0) AS unusable FROM nation""")
def share_import_report(spark, d):
    listed = spark.sql(_LEGACY, nation=spark.read.parquet(f"{d}/nation.parquet"))
    return results.import_report(results.imported(listed, view(spark, d, "fx_share")))


@query("""SELECT 100 + n_nationkey AS legacy_id, CASE WHEN n_nationkey % 4 > 0 AND n_nationkey % 6 > 0 THEN concat(n_name, ' → P1 (en.wikipedia)') END AS title,
    CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 6 = 0 THEN 'unusable' WHEN n_nationkey % 5 = 0 THEN 'already there' ELSE 'imported' END AS outcome FROM nation""")
def share_import(spark, d):
    return results.imported(spark.sql(_LEGACY, nation=spark.read.parquet(f"{d}/nation.parquet")), view(spark, d, "fx_share")).select("legacy_id", "title", "outcome")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN user_name = 'user 0' ELSE user_id = 2 END AS mine FROM fx_share")
def share_ownership(spark, d):
    return view(spark, d, "fx_share").select("id", results.owned_by(F.col("user_id"), F.col("user_name"), 2, "user 0").alias("mine"))


@query("""SELECT n_nationkey AS id, 'de.wikipedia' AS wiki, concat('P', CAST(n_nationkey AS STRING)) AS property, n_name AS template, CASE n_nationkey % 4 WHEN 0 THEN 'page title' WHEN 1 THEN 'y, d' WHEN 2 THEN '{1}-{2}' ELSE 'a, b' END AS parameters FROM nation""")
def share_rows(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey") % 4
    spec = F.to_json(F.struct(F.lit("de").alias("siteid"), F.lit("wikipedia").alias("project"), F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("property"), F.col("n_name").alias("template"), F.array(F.lit("a"), F.lit("b")).alias("parameters"), F.when(k == 1, F.array(F.lit("y"), F.lit(None), F.lit("d"))).alias("date_parameters"), F.when(k == 2, "{1}-{2}").alias("value_pattern"), (k == 0).alias("use_page_title")))
    return n.select(F.col("n_nationkey").alias("id"), results.share_row(spec).alias("r")).select("id", "r.*")


@query("SELECT s.id, s.title, coalesce(string_agg(DISTINCT t.tag, ',' ORDER BY t.tag), '') AS tags FROM fx_share s LEFT JOIN fx_share_tag t ON t.share_id = s.id GROUP BY s.id, s.title")
def tags_per_share(spark, d):
    return results.shares_with_tags(view(spark, d, "fx_share"), view(spark, d, "fx_share_tag")).select("id", "title", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, title FROM fx_share s WHERE lower(title) LIKE '%tion_1%' AND EXISTS (SELECT 1 FROM fx_share_tag t WHERE t.share_id = s.id AND t.tag = 'region-2')")
def share_search(spark, d):
    tagged = results.shares_with_tags(view(spark, d, "fx_share"), view(spark, d, "fx_share_tag"))
    return results.search(tagged, "Tion_1", ["title"], "region-2").select("id", "title")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS nth, concat('Nr ', CAST(n_nationkey AS STRING), '000000000000') AS title FROM nation")
def natural_order(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("Nr "), F.col("n_nationkey").cast("string"), F.lit("000000000000")).alias("title"))
    return n.withColumn("nth", F.row_number().over(Window.orderBy(results.natural_key(F.col("title"))))).select("nth", "title")


# the flagship: from rendered pages to outcomes


@query("""SELECT p_partkey AS page_id, concat('tt', CAST(p_partkey AS STRING)) AS value, CASE WHEN p_partkey % 5 = 0 THEN 'the page has no Wikidata item' WHEN p_partkey % 4 = 0 THEN 'template not found' WHEN p_partkey % 7 = 0 THEN 'no value'
        WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P1') THEN 'the item already has the property' END AS message,
        CASE WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P1') THEN 'skipped' ELSE 'ready' END AS status
    FROM part WHERE NOT (p_partkey % 5 = 0 OR p_partkey % 4 = 0 OR p_partkey % 7 = 0)
    UNION ALL SELECT p_partkey, NULL, CASE WHEN p_partkey % 5 = 0 THEN 'the page has no Wikidata item' WHEN p_partkey % 4 = 0 THEN 'template not found' ELSE 'no value' END, 'skipped' FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 4 = 0 OR p_partkey % 7 = 0""")
def harvest_external_id(spark, d):
    text = "CASE WHEN p_partkey % 4 = 0 THEN 'no template' WHEN p_partkey % 7 = 0 THEN '{{IMDb title|id= }}' ELSE concat('x {{iMDb_title|id=', p_partkey, '|t=', p_name, '}}') END"
    spec = from_query("siteid=en&project=wikipedia&p=1&template=IMDb title&parameters=id&addprefix=tt&skipremoved=0")
    return _evaluated(spark, d, text, spec, "external-id", _claims(spark, d)).select("page_id", F.when(F.col("item").isNotNull(), F.col("value")).alias("value"), "message", "status")


def _claims(spark, d):
    kinds = "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude"
    return view(spark, d, "fx_claims").selectExpr("item", "property", "rank", "item_value", "text_value", "amount", "year", "month", "day", *kinds)


def _evaluated(spark, d, text, spec, datatype, claims, rules=(), **catalog):
    """Outcomes of pages rendered from parts."""
    pages = _rendered(spark, d, "%body%", body=text)
    rows = pages.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("Q"), F.col("p_partkey").cast("string"))).alias("item"))
    revisions = pages.select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("revision_id"), F.col("wikitext").alias("text"))
    return evaluate(rows, revisions, spec, datatype, Catalog(claims, **catalog), rules)


# lookups


@query("""SELECT o_orderkey AS page_id, CASE WHEN p_partkey IS NULL THEN 'the page no longer exists' END AS message, p_partkey AS revision_id FROM orders LEFT JOIN part ON p_partkey = o_orderkey""")
def revision_join(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("page_id"))
    revisions = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("revision_id"), F.col("p_name").alias("text"))
    return lookups.with_revisions(rows, revisions).select("page_id", "message", "revision_id")


@query("""SELECT c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS target, CASE WHEN c_custkey % 2 = 0 AND n_nationkey % 3 > 0 THEN concat('Q', CAST(n_nationkey AS STRING)) END AS item,
    CASE WHEN c_custkey % 2 = 1 THEN 'missing' WHEN n_nationkey % 3 = 0 THEN 'no_item' ELSE 'item' END AS state FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def link_target_lookup(spark, d):
    customer, nation = spark.read.parquet(f"{d}/customer.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    redirects = customer.where("c_custkey % 2 = 0").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("from_title"), F.col("n_name").alias("to_title"))
    pages = nation.select(F.col("n_name").alias("title"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("Q"), F.col("n_nationkey").cast("string"))).alias("item"))
    return lookups.link_targets(customer.select(F.col("c_name").alias("title")), redirects, pages)


@query("SELECT p_partkey AS name, CASE WHEN p_size <= 10 THEN 'missing' WHEN p_size <= 25 THEN 'local' ELSE 'shared' END AS state FROM part")
def file_location_lookup(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    images = part.where("p_size > 10").select(F.col("p_partkey").alias("name"), F.when(F.col("p_size") <= 25, "local").otherwise("shared").alias("repository"))
    return lookups.file_locations(part.select(F.col("p_partkey").alias("name")), images)


@query("SELECT s_suppkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, concat('Q', CAST(s_nationkey AS STRING))) AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def label_fallback(spark, d):
    labels = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 2 = 0").select(F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("item"), F.lit("en").alias("language"), F.col("n_name").alias("text"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.concat(F.lit("Q"), F.col("s_nationkey").cast("string")).alias("item"))
    return lookups.with_labels(rows, labels, "item").select("s_suppkey", "label")


@query("""SELECT n_nationkey, concat(lower(replace(n_name, ' ', '')), 'wiki') AS dbname, 'Vorlage' AS template, 'Template,Vl,Vorlage' AS prefixes, n_nationkey % 2 = 0 AS first_letter FROM nation""")
def site_info(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    info = F.concat(F.lit('{"general":{"wikiid":"'), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit('wiki","lang":"de"},"namespaces":{"0":{"id":0,"name":""},"10":{"id":10,"name":"Vorlage","canonical":"Template","case":"'), F.when(F.col("n_nationkey") % 2 == 0, "first-letter").otherwise("case-sensitive"), F.lit('"}},"namespacealiases":[{"id":10,"alias":"Vl"},{"id":6,"alias":"Image"}]}'))
    s = n.select("n_nationkey", lookups.site(info).alias("s"))
    return s.select("n_nationkey", "s.dbname", F.element_at("s.namespaces", 10).alias("template"), F.array_join(F.array_sort("s.template_prefixes"), ",").alias("prefixes"), "s.first_letter")


@query("SELECT r_regionkey, concat('n', CAST(n_nationkey AS STRING)) AS id, n_name AS title FROM nation JOIN region ON r_regionkey = n_regionkey")
def share_list_scan(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("tr", F.concat(F.lit("<tr><td><a href='?htid=n"), F.col("n_nationkey").cast("string"), F.lit("'>x</a></td><td>"), "n_name", F.lit("</td></tr>\n")))
    pages = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list("tr"), ""), F.lit("</table>")).alias("html"))
    rows = pages.select("r_regionkey", F.explode(lookups.table_rows(F.col("html"), r"<tr><td><a href='\?htid=(\w+)'>[^<]*</a></td><td>([^<]*)</td></tr>", 2)).alias("t"))
    return rows.select("r_regionkey", F.col("t.c1").alias("id"), F.col("t.c2").alias("title"))


@query("""SELECT n_nationkey, 'name' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'ids', CAST(n_nationkey AS STRING) FROM nation UNION ALL SELECT n_nationkey, 'ids', 'x' FROM nation
    UNION ALL SELECT n_nationkey, 'ok', 'true' FROM nation""")
def json_pairs(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    body = F.concat(F.lit('{"name":"'), "n_name", F.lit('","ids":['), F.col("n_nationkey").cast("string"), F.lit(',"x"],"ok":true}'))
    return lookups.json_pairs(n.select("n_nationkey", body.alias("body")), "n_nationkey", "body")


@query("""WITH k AS (SELECT p_brand AS property, p_type AS kind, max(CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END) AS r, min(p_partkey) AS position FROM part GROUP BY p_brand, p_type)
    SELECT property, kind, CASE r WHEN 2 THEN 'mandatory' WHEN 1 THEN 'normal' ELSE 'suggestion' END AS status, position FROM k""")
def constraint_strictest_status(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    status = F.when(F.col("p_size") > 40, "mandatory").when(F.col("p_size") > 20, "normal").otherwise("suggestion")
    return lookups.strictest_status(part.select(F.col("p_brand").alias("property"), F.col("p_type").alias("kind"), status.alias("status"), F.col("p_partkey").alias("position")))


@query("SELECT item, string_agg(DISTINCT property, ',' ORDER BY property) AS properties FROM fx_claims GROUP BY item")
def property_ids(spark, d):
    return properties_of(view(spark, d, "fx_claims")).select("item", F.array_join("properties", ",").alias("properties"))


@query("SELECT item, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY claim_id DESC) AS n FROM fx_claims) WHERE n <= 3")
def latest_history(spark, d):
    return lookups.latest_per(view(spark, d, "fx_claims"), "item", "claim_id", 3).select("item", "claim_id")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'done' WHEN event_type = 'click' OR (event_type = 'error' AND event_id % 2 = 0) THEN 'busy' WHEN event_type = 'signup' THEN 'fatal' ELSE 'rejected' END AS outcome,
    CASE WHEN event_type = 'click' THEN least(60, greatest(5, CAST(event_id % 90 AS INT))) WHEN event_type = 'error' AND event_id % 2 = 0 THEN 60 END AS wait FROM events""")
def edit_outcomes(spark, d):
    e, even = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 2 == 0
    code = F.when(F.col("event_type") == "click", "maxlag").when(F.col("event_type") == "purchase", "modification-failed").when(F.col("event_type") == "signup", F.when(even, "blocked").otherwise("readonly")).when(F.col("event_type") == "error", F.when(even, "ratelimited").otherwise("internal_error"))
    return e.select("event_id", lookups.edit_outcome(code, F.col("event_id") % 90).alias("o")).select("event_id", F.col("o.class").alias("outcome"), "o.wait")


@query("SELECT c_custkey AS id, concat('Q', CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS STRING)) AS current, (CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END) % 2 = 0 AS exists FROM customer")
def current_items(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    merges = c.where("c_custkey % 3 = 0").select(q(F.col("c_custkey")).alias("from_item"), q(F.col("c_custkey") + 1).alias("to_item"))
    there = spark.range(0, 2_000_000, 2).select(q(F.col("id")).alias("item"))
    out = lookups.current_items(c.select(q(F.col("c_custkey")).alias("item")), merges, there)
    return out.select(F.substr("item", F.lit(2)).cast("bigint").alias("id"), "current", "exists")


@query("SELECT DISTINCT concat('Q', CAST(n_nationkey AS STRING)) AS item, CASE l WHEN 0 THEN n_name WHEN 1 THEN concat('alias ', n_name) ELSE 'sym' END AS text FROM nation, (VALUES (0), (1), (2)) AS x(l) WHERE n_nationkey % 2 = 0")
def names_and_symbols(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("item", F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")))
    said = n.select("item", F.explode(F.array(F.struct(F.lit("en").alias("language"), F.col("n_name").alias("text")), F.struct(F.lit("cs").alias("language"), F.concat(F.lit("alias "), "n_name").alias("text")), F.struct(F.lit("fr").alias("language"), F.lit("non").alias("text")))).alias("x")).select("item", "x.*")
    return lookups.names_of(n.where("n_nationkey % 2 = 0").select("item"), said, n.select("item", F.lit("sym").alias("text")), ["en", "cs"])


@query("SELECT lower(replace(n_name, '_', '')) AS siteid, n_name AS title, concat(lower(replace(n_name, '_', '')), '.wikipedia.org') AS host FROM nation WHERE n_nationkey % 3 = 0")
def other_wikis(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    code = F.lower(F.replace("n_name", F.lit("_"), F.lit("")))
    url = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("https://"), code, F.lit(".wikipedia.org/wiki/x"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("https://"), code, F.lit(".m.wikipedia.org/wiki/x"))).otherwise(F.concat(F.lit("https://"), code, F.lit(".wiktionary.org/wiki/x")))
    return lookups.on_other_wikis(n.select(F.col("n_name").alias("title"), url.alias("url")), "wikipedia")


@query("SELECT brand AS type, string_agg(item, ',' ORDER BY item) AS items FROM fx_page WHERE item IS NOT NULL AND brand IN ('Brand#2', 'Brand#4') GROUP BY brand")
def items_by_type(spark, d):
    page = view(spark, d, "fx_page").where("item IS NOT NULL")
    out = lookups.items_by_type(page.select("item", F.lit("P31").alias("property"), F.col("brand").alias("item_value")), page.select("item"), ["Brand#2", "Brand#4"])
    return out.select("type", F.array_join("items", ",").alias("items"))


@query("SELECT DISTINCT item FROM fx_claims WHERE amount > 300000 AND property = 'P1'")
def user_query_items(spark, d):
    view(spark, d, "fx_claims").createOrReplaceTempView("claims_of_user")
    return lookups.user_items(spark, "SELECT CASE WHEN rank = 'normal' THEN item ELSE item END AS item FROM claims_of_user WHERE amount > 300000 AND property = 'P1' UNION ALL SELECT 'not an item'")


@query("SELECT DISTINCT item, 'enwiki' AS dbname, title, concat('https://en.wikipedia.org/wiki/', CAST(page_id AS STRING)) AS url FROM fx_page WHERE item IN (SELECT item FROM fx_claims)")
def item_sitelinks(spark, d):
    page = view(spark, d, "fx_page").where("item IS NOT NULL")
    links = page.select("item", F.lit("enwiki").alias("dbname"), "title", F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.col("page_id").cast("string")).alias("url"))
    return lookups.sitelinks(links, view(spark, d, "fx_claims"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1")
def template_redirect_names(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    redirects = n.select(F.col("n_name").alias("from_title"), F.concat(F.lit("box_"), F.col("n_regionkey").cast("string")).alias("to_title")).where("from_title <> 'NATION_1'")
    found = lookups.template_redirects("Box 1", redirects, spark.createDataFrame([("Box_1",)], "title string"))
    return spark.createDataFrame([(x.replace(" ", "_"),) for x in found], "name string")


# the whole evaluation, over rendered pages


_HELD = "EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P1'{more})"


@query(f"""WITH x AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'the page has no Wikidata item' WHEN p_partkey % 6 = 0 THEN 'unclear number' WHEN p_partkey % 3 = 1 OR {_HELD.format(more=" AND c.rank <> 'deprecated' AND c.amount = p_size + 0.5")} THEN 'the item already has this value'
        WHEN p_size > 45 THEN 'constraint violation: range' END AS message FROM part)
    SELECT p_partkey AS page_id, CASE WHEN p_partkey % 6 > 0 THEN concat('+', CAST(p_size AS STRING), '.50 Q11570') END AS value, message,
    CASE WHEN message IS NULL THEN 'ready' WHEN message LIKE 'the %' THEN 'skipped' ELSE 'error' END AS status FROM x""")
def evaluate_quantities(spark, d):
    text = "CASE WHEN p_partkey % 6 = 0 THEN '{{Box|w=about two}}' ELSE concat('{{Box|w=', p_size, '.50 [[Kilogram|kg.]]}}') END"
    units = spark.createDataFrame([("kilogram", "Q11570"), ("kg", "Q11570")], "name string, unit string")
    # every third part already has its own size
    same = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 = 1").selectExpr("concat('Q', p_partkey) AS item", "'P1' AS property", "'normal' AS rank", "CAST(NULL AS STRING) AS item_value", "CAST(NULL AS STRING) AS text_value", "p_size + 0.5D AS amount", "1900L AS year", "0 AS month", "0 AS day", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude")
    spec = JobSpec(property="P1", template="Box", parameters=("w",), skip_any_value=False)
    return _evaluated(spark, d, text, spec, "quantity", _claims(spark, d).unionByName(same), [C.Definition("Q21510860", "normal", {"P2312": ["+46"]})], units=units).select("page_id", "value", "message", "status")


@query("""WITH x AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 'the page has no Wikidata item' WHEN p_partkey % 4 = 0 THEN 'no value'
        WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P2' AND c.rank <> 'deprecated' AND c.text_value = concat('tt', CAST(p_partkey % 401 AS STRING))) THEN 'the item already has this value'
        WHEN p_partkey % 401 < 100 THEN 'constraint violation: format'
        WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.item <> concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P2' AND c.text_value = concat('tt', CAST(p_partkey % 401 AS STRING))) THEN 'constraint violation: distinct values'
        WHEN EXISTS (SELECT 1 FROM fx_history h WHERE h.item = concat('Q', CAST(p_partkey AS STRING)) AND contains(h.comment, 'wbremoveclaims-remove') AND (contains(h.comment || ' ', concat('Property:P2]]: tt', CAST(p_partkey % 401 AS STRING), ' ')) OR contains(h.comment, concat('Property:P2]]: tt', CAST(p_partkey % 401 AS STRING), ',')))) THEN 'this value was removed from the item before' END AS message FROM part)
    SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 > 0 THEN concat('tt', CAST(p_partkey % 401 AS STRING)) END AS value, message, CASE WHEN message IS NULL THEN 'ready' WHEN message LIKE 'constraint%' THEN 'error' ELSE 'skipped' END AS status FROM x""")
def evaluate_texts(spark, d):
    text = "CASE WHEN p_partkey % 4 = 0 THEN '{{Box|id=–}}' ELSE concat('{{Box|id=[http://x ', '] tt', p_partkey % 401, '}}') END"
    spec = JobSpec(property="P2", template="Box", parameters=("id",), search="^.*\\] ", skip_any_value=False, constraints=("Q21502410", "Q21502404"))
    rules = [C.Definition("Q21502404", "mandatory", {"P1793": ["tt[0-9]{3,}"]}), C.Definition("Q21502410"), C.Definition("Q19474404")]
    return _evaluated(spark, d, text, spec, "external-id", _claims(spark, d), rules, history=view(spark, d, "fx_history")).select("page_id", "value", "message", "status")


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN '1950' WHEN 1 THEN '1950-03-07' WHEN 2 THEN '1999-05' ELSE '1960' END AS value FROM part WHERE p_partkey % 5 > 0""")
def evaluate_dates_with_help(spark, d):
    text = "concat('{{Box|d=', CASE p_partkey % 4 WHEN 0 THEN 'in 1950' WHEN 1 THEN '7. brezen 1950' WHEN 2 THEN 'kveten dvacet' ELSE 'brezen 1960' END, '}}')"
    dates = spark.createDataFrame([("7. brezen 1950", "cs", 1950, 3, 7, 11), ("kveten dvacet", "cs", 1999, 5, 0, 10), ("brezen 1960", "cs", 1961, 3, 0, 10), ("in 1950", "de", 1950, 1, 1, 11)], "text string, language string, year bigint, month int, day int, precision int")
    spec = JobSpec(property="P5", template="Box", parameters=("d",), skip_any_value=False)
    out = _evaluated(spark, d, text, spec, "time", _claims(spark, d).where("false"), months={}, language="cs", dates=dates)
    return out.where("item IS NOT NULL").select("page_id", "value")


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN concat('Q', CAST(100000 + p_size AS STRING)) END AS value,
    CASE p_partkey % 4 WHEN 1 THEN '[[Nowhere]] does not exist' WHEN 2 THEN '[[Bare]] has no Wikidata item' WHEN 3 THEN 'the link points to the page itself' END AS message FROM part WHERE p_partkey % 5 > 0""")
def evaluate_items(spark, d):
    text = "concat('{{Box|v={{icon}} [[', CASE p_partkey % 4 WHEN 0 THEN concat('target_', p_size) WHEN 1 THEN 'Nowhere' WHEN 2 THEN 'Bare' ELSE concat('Self ', p_partkey) END, '|label]] rest}}')"
    part = spark.read.parquet(f"{d}/part.parquet")
    known = part.selectExpr("concat('Target ', p_size) AS title", "concat('Q', 100000 + p_size) AS item").distinct().union(part.selectExpr("concat('Self ', p_partkey)", "concat('Q', p_partkey)")).union(spark.createDataFrame([("Bare", None)], "title string, item string"))
    spec = JobSpec(property="P6", template="Box", parameters=("v",))
    return _evaluated(spark, d, text, spec, "wikibase-item", _claims(spark, d), link_targets=known).where("item IS NOT NULL").select("page_id", "value", "message")


@query("""SELECT p_partkey AS page_id, CASE WHEN p_size > 10 THEN CASE WHEN p_size > 25 THEN concat('Part ', CAST(p_partkey AS STRING), '.jpg') END END AS value,
    CASE WHEN p_size <= 10 THEN 'the file does not exist' WHEN p_size <= 25 THEN 'the file is only on dewiki, not on Commons' END AS message FROM part WHERE p_partkey % 5 > 0""")
def evaluate_files(spark, d):
    files = spark.read.parquet(f"{d}/part.parquet").where("p_size > 10").selectExpr("concat('Part ', p_partkey, '.jpg') AS name", "p_size > 25 AS shared")
    spec = JobSpec(property="P6", template="Box", parameters=("image",))
    return _evaluated(spark, d, "concat('{{Box|image=[[Image:part_', p_partkey, '.jpg|thumb]]}}')", spec, "commonsMedia", _claims(spark, d), files=files, dbname="dewiki").where("item IS NOT NULL").select("page_id", "value", "message")


@query("""SELECT p_partkey AS page_id, concat(CAST(p_size AS STRING), '.50, ', CAST(p_partkey % 170 AS STRING), '.25') AS value FROM part WHERE p_partkey % 5 > 0""")
def evaluate_coordinates(spark, d):
    text = "CASE WHEN p_partkey % 2 = 0 THEN concat('{{Coord|', p_size, '|30|N|', p_partkey % 170, '|15|E|type:city}}') ELSE concat('{{Coord|', p_size, '.50|', p_partkey % 170, '.25}}') END"
    out = _evaluated(spark, d, text, JobSpec(property="P6", template="Coord", parameters=("1",)), "globe-coordinate", _claims(spark, d))
    return out.where("item IS NOT NULL").select("page_id", "value")


@query(r"""SELECT p_partkey AS page_id, concat('x', CAST(p_partkey AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '; P580: 1999-05' ELSE '' END, '; P642: Q5') AS value,
    concat('{"type":"statement","rank":"normal","mainsnak":{"snaktype":"value","property":"P6","datatype":"string","datavalue":{"value":"x', CAST(p_partkey AS STRING), '","type":"string"}},"qualifiers":{',
        CASE WHEN p_partkey % 2 = 0 THEN '"P580":[{"snaktype":"value","property":"P580","datatype":"time","datavalue":{"value":{"time":"+1999-05-00T00:00:00Z","timezone":0,"before":0,"after":0,"precision":10,"calendarmodel":"http://www.wikidata.org/entity/Q1985727"},"type":"time"}}],' ELSE '' END,
        '"P642":[{"snaktype":"value","property":"P642","datatype":"wikibase-item","datavalue":{"value":{"entity-type":"item","numeric-id":5,"id":"Q5"},"type":"wikibase-entityid"}}]},"qualifiers-order":[', CASE WHEN p_partkey % 2 = 0 THEN '"P580",' ELSE '' END, '"P642"],',
        '"references":[{"snaks":{"P143":[{"snaktype":"value","property":"P143","datatype":"wikibase-item","datavalue":{"value":{"entity-type":"item","numeric-id":328,"id":"Q328"},"type":"wikibase-entityid"}}],"P4656":[{"snaktype":"value","property":"P4656","datatype":"url","datavalue":{"value":"https://en.wikipedia.org/w/index.php?title=',
        replace(p_name, ' ', '_'), '&oldid=', CAST(p_partkey AS STRING), '","type":"string"}}]},"snaks-order":["P143","P4656"]}]}') AS statement FROM part WHERE p_partkey % 5 > 0""")
def evaluate_statements(spark, d):
    text = "concat('{{Box|v=x', p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '|since=May 1999' ELSE '|since= ' END, '}}')"
    spec = JobSpec(property="P6", template="Box", parameters=("v",), qualifiers=(("P580", "param", "from,since"), ("P642", "fixed", "Q5")))
    pages = _rendered(spark, d, "%body%", body=text)
    rows = pages.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item")).where("page_id % 5 > 0")
    revisions = pages.select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("revision_id"), F.col("wikitext").alias("text"))
    out = evaluate(rows, revisions, spec, "string", Catalog(_claims(spark, d)), datatypes={"P580": "time", "P642": "wikibase-item"})
    return out.select("page_id", "value", "statement")




@query(_DAYS)
def date_other_languages(spark, d):
    """German with a point, Spanish with particles, French ordinals, Basque with endings, Hungarian year first: each with its own month names."""
    named = N.month_names(spark, ["de", "es", "fr", "eu", "hu"])
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").cast("string").alias("t"))
    out = None
    for i, (language, form) in enumerate({"de": "concat(t, '. ', n, ' ', y)", "es": "concat(t, ' de ', n, ' de ', y)", "fr": "concat(t, 'er ', n, ' ', y)", "eu": "concat(y, 'ko ', n, 'aren ', t, 'a')", "hu": "concat(y, '. ', n, ' ', t, '.')"}.items()):
        longest: dict[int, str] = {}
        for name, month in named[language].items():
            longest[month] = max(longest.get(month, ""), name, key=len)
        names = F.element_at(F.array(*(F.lit(longest[k].capitalize()) for k in range(1, 13))), F.col("m"))
        part = o.where(F.col("o_orderkey") % 5 == i).withColumn("n", names)
        part = part.select("o_orderkey", N.parse_date(F.expr(form), named[language]).alias("d"), "n").select("o_orderkey", "d.date.year", "d.date.month", "d.date.day")
        out = part if out is None else out.union(part)
    return out
