"""Queries of whole runs: users' patterns, all fields of a job at once, wikis of their own, merged items, statements that are laid out, stores and dumps. Each has SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions import wikitext as W
from tessera.operators import claims as K
from tessera.operators import closure, constraints, existing
from tessera.plans import pages, properties, results, run
from tessera.plans.evaluate import Catalog, Field, evaluate_fields
from tessera.plans.job import JobSpec
from tessera.plans.lineage import scratch, spread
from tessera.plans.store import RunStore
from tessera.queries import _claims, _rendered, query
from tessera.sources import lookups
from tessera.sources.fixtures import view

# users' patterns

#: Text that the patterns run over, in either engine's SQL.
_SAID = "concat(p_name, '|', p_type, ' (', p_brand, ') ', CAST(p_size AS STRING), '-', CAST(p_partkey AS STRING), '.')"
#: pattern, replacement as users write it, and as the other engine takes it
PATTERNS = [
    (r"\p{Lu}", "_", "_"), (r"\pL+", "w", "w"), (r"\P{L}", "", ""), (r"\p{Ll}{2,}", "<$0>", r"<\0>"), (r"(?P<x>[0-9])", "$x$x", r"\1\1"), (r"(?<y>[A-Z])", "[${y}]", r"[\1]"), (r"([0-9]+)-([0-9]+)", "$2a$1", r"\2a\1"), (r"([0-9])", "$2", ""), (r"#", "${nm}", ""),
    (r"([A-Z])([0-9])?", "$2$1", r"\2\1"), (r"[0-9]", "$", "$"), (r"[0-9]", "$$", "$"), (r"[0-9]", "a$b c", "a c"), (r"([0-9])", "$10", ""), (r"([0-9])", "$01", r"\1"), (r"[0-9]*", "x", "x"), (r"[a-z]*?", "-", "-"), (r"(?i)brand", "b", "b"), (r"(?i:PART)-?", "p", "p"),
    (r"[[:alpha:]]+", "w", "w"), (r"[[:^digit:]]", "", ""), (r"[^\d\s]+", ".", "."), (r"[]|]", "x", "x"), (r"[a\-z]", "x", "x"), (r"\x41|\x{42}", "x", "x"), (r"\.|\(|\)", "", ""), (r"\b[0-9]+\b", "n", "n"), (r"(?U)[0-9]+", "d", "d"), (r"(?U)[0-9]+?", "d", "d"), (r"(?s)^.*-", "", ""),
    (r"^", ">", ">"), (r"$", "<", "<"), (r"(|B)r", "x", "x"), (r"(?:a|r|t)*", "x", "x"), (r"(?:[0-9]+)+", "n", "n"), (r"[0-9]{2}{2}", "4", "4"), (r"([a-z]+#)*[0-9]", "x", "x"), (r"\A\w+", "first", "first"), (r"\w+\z", "last", "last"), (r"[A-Z][a-z]+|[0-9]+", "($0)", r"(\0)"), (r"B(?:r(?:a(?:n(?:d)?)?)?)?", "b", "b"),
]
# (the other engine's names of groups have their own spelling, and it can't repeat a repeat)
_OTHER = {r"(?<y>[A-Z])": r"([A-Z])", r"[0-9]{2}{2}": r"[0-9]{4}", r"[0-9]": r"[0-9]"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern_sql() -> str:
    listed = " UNION ALL ".join(f"SELECT p_partkey, {i} AS pattern, regexp_replace(said, {_quoted(_OTHER.get(p, p))}, {_quoted(r)}, 'g') AS value FROM s" for i, (p, _, r) in enumerate(PATTERNS))
    return f"WITH s AS (SELECT p_partkey, {_SAID} AS said FROM part) {listed}"


@query(_pattern_sql())
def pattern_replacements(spark, d):
    rows = spread(spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", f"{_SAID} AS said"), "p_partkey")
    made = F.array(*(F.struct(F.lit(i).alias("pattern"), T.transform(F.col("said"), search=p, replacement=r).alias("value")) for i, (p, r, _) in enumerate(PATTERNS)))
    return rows.select("p_partkey", F.explode(made).alias("x")).select("p_partkey", "x.pattern", "x.value")


#: format patterns and what they come to in the other engine's SQL; the last ones are ambiguous and run in linear time, or aren't understood and are met by all values
FORMATS = [
    (r"[A-Za-z_#]+\d+", r"regexp_full_match(v, '[A-Za-z_#]+\d+')"), (r"(?!B).*", "NOT starts_with(v, 'B')"), (r"(?=.*7).*\d", "contains(v, '7') AND regexp_full_match(v, '.*\\d')"), (r"([a-z])*.*\d\d", r"regexp_full_match(v, '.*\d\d')"), (r"(?i)brand#\d*", r"regexp_full_match(v, '(?i)brand#\d*')"),
    (r".*(\d)\1", "regexp_matches(v, '(00|11|22|33|44|55|66|77|88|99)$')"), (r"(?P<d>\d).*|B.*(?P<e>\d)(?P=e).*", "regexp_matches(v, '^\\d|^B.*(00|11|22|33|44|55|66|77|88|99)')"), (r"(?>Brand#)\d++", r"regexp_full_match(v, 'Brand#\d+')"), (r"([A-Za-z]+#?)+\d", r"regexp_full_match(v, '([A-Za-z]+#?)+\d')"),
    (r"(Br|B|r|a|n|d|[a-z])*#[0-9]+", "regexp_full_match(v, '[Brand]?[a-z]*#[0-9]+')"), (r"(", "true"), (r"(?(1)a|b)", "true"), (r"", "v = ''"),
]


@query("WITH s AS (SELECT p_partkey, p_brand AS v FROM part) " + " UNION ALL ".join(f"SELECT p_partkey, {i} AS pattern, NOT ({sql}) AS violated FROM s" for i, (_, sql) in enumerate(FORMATS)))
def constraint_format_patterns(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    made = F.array(*(F.struct(F.lit(i).alias("pattern"), constraints.format_(F.col("p_brand"), p).alias("violated")) for i, (p, _) in enumerate(FORMATS)))
    return rows.select("p_partkey", F.explode(made).alias("x")).select("p_partkey", "x.pattern", "x.violated")


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS removed FROM part")
def mentions_of_any_value(spark, d):
    """Values with signs that end quotations or are operators."""
    part = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "concat('C:\\\\E', p_name, '(\\\\Q*') AS value")
    comment = F.concat(F.lit("/* wbremoveclaims-remove:1| */ [[Property:P1]]: "), F.col("value"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "x").otherwise(", more"))
    rows = part.select("p_partkey", F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item"), F.lit("P1").alias("property"), "value")
    history = part.select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item"), F.col("p_partkey").alias("rev"), comment.alias("comment"))
    gone = existing.removed_before(rows, history).select("p_partkey", F.lit(True).alias("removed"))
    return rows.select("p_partkey").join(gone, "p_partkey", "left").select("p_partkey", F.coalesce("removed", F.lit(False)).alias("removed"))


# values


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat('First ', p_partkey) WHEN 2 THEN p_type END AS target FROM part")
def links_that_are_not_closed(spark, d):
    text = "CASE p_partkey % 4 WHEN 0 THEN concat('[[', p_name) WHEN 1 THEN concat('see [[First ', p_partkey, '|x]] [[y') WHEN 2 THEN concat('[[', p_type, '|open') ELSE 'none' END"
    return _rendered(spark, d, "%body%", body=text).select("p_partkey", T.link_target(F.col("wikitext")).alias("target"))


@query("SELECT p_partkey, CAST(p_partkey % 90 AS DOUBLE) + 0.5 AS latitude, CAST(p_size AS DOUBLE) + 0.25 AS longitude FROM part")
def coordinates_in_other_numerals(spark, d):
    digits = lambda c, zero: f"translate(CAST({c} AS STRING), '0123456789', '{''.join(chr(zero + i) for i in range(10))}')"
    text = f"concat('{{{{Coord|', {digits('p_partkey % 90', 0x660)}, '|{chr(0x663)}{chr(0x660)}|N|', {digits('p_size', 0x966)}, '|', {digits('15', 0x966)}, '|E|type:city}}}}')"
    found = N.parse_coordinate(W.coordinate_params(F.col("wikitext")))
    return _rendered(spark, d, "%body%", body=text).select("p_partkey", found.alias("c")).select("p_partkey", F.round("c.latitude", 6).alias("latitude"), F.round("c.longitude", 6).alias("longitude"))


def _world(spark, d, text, keep="true"):
    """(pages, revisions) rendered from parts."""
    rows = _rendered(spark, d, "%body%", body=text).where(keep)
    return rows.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("title"), F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("item")), rows.select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("revision_id"), F.col("wikitext").alias("text"))


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN concat('+', CAST(p_size AS STRING), ' Q41803') WHEN 1 THEN concat('+', CAST(p_size AS STRING), ' Q11570') WHEN 2 THEN concat('+', CAST(p_size AS STRING), ' Q11570') END AS value,
    CASE WHEN p_partkey % 4 = 3 THEN 'unknown unit ''parsecs''' END AS message FROM part""")
def evaluate_units_in_texts(spark, d):
    """A unit is chosen; those that a text names itself win, and unknown ones are errors."""
    units = spark.createDataFrame([("g", "Q41803"), ("gram", "Q41803"), ("kg", "Q11570")], "name string, unit string")
    text = "concat('{{Box|w=', p_size, CASE p_partkey % 4 WHEN 0 THEN ' [[Gram|g]]' WHEN 1 THEN '' WHEN 2 THEN '&nbsp;Kg.' ELSE ' parsecs' END, '}}')"
    out = evaluate_fields(*_world(spark, d, text), [Field(JobSpec(property="P9", template="Box", parameters=("w",), unit="Q11570"), "quantity")], Catalog(_claims(spark, d), units=units))
    return out.select("page_id", "value", "message")


@query("""WITH f AS (SELECT p_partkey, 0 AS field, p_name AS value, CASE WHEN p_partkey % 3 = 0 THEN 'no value' END AS message FROM part
        UNION ALL SELECT p_partkey, 1, concat('tt', CAST(p_partkey AS STRING)), CASE WHEN EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P2') THEN 'the item already has the property' END FROM part
        UNION ALL SELECT p_partkey, 2, concat(CAST(1930 + p_size AS STRING), '-05'), CASE WHEN p_size > 40 THEN 'constraint violation: range' END FROM part
        UNION ALL SELECT p_partkey, 3, concat('+', CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END), CASE WHEN p_size % 2 = 0 THEN 'constraint violation: integer' END FROM part)
    SELECT p_partkey AS page_id, field, CASE WHEN message IS DISTINCT FROM 'no value' THEN value END AS value, message FROM f""")
def evaluate_four_fields(spark, d):
    """Four properties of one template in one pass: each with its own parameter, datatype, claims and rules."""
    text = "concat('{{Box|a=', CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE ' ' END, '|b=', p_partkey, '|c=May ', 1930 + p_size, '|d=', p_size, CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END, '}}')"
    spec = lambda p, n, **more: JobSpec(property=p, template="Box", parameters=(n,), skip_any_value=True, **more)
    late = constraints.Definition("Q21510860", "mandatory", {"P2311": ["+1970-12-31T00:00:00Z"]})
    fields = [
        Field(spec("P91", "a"), "string"), Field(spec("P2", "b", add_prefix="tt"), "external-id"), Field(spec("P92", "c", constraints=("Q21510860",)), "time", [late]),
        Field(spec("P93", "d"), "quantity", [constraints.Definition("Q52848401", "mandatory"), constraints.Definition("Q21502404", "mandatory", {"P1793": ["x"]})]),
    ]
    return evaluate_fields(*_world(spark, d, text), fields, Catalog(_claims(spark, d))).select("page_id", "field", "value", "message")


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'the item already has this value' END AS message FROM part""")
def evaluate_texts_in_a_language(spark, d):
    """The same text in the same language, in another one, in none, and of a deprecated statement."""
    part = spark.read.parquet(f"{d}/part.parquet")
    held = part.selectExpr("concat('Q', p_partkey) AS item", "'P9' AS property", "CASE WHEN p_partkey % 4 = 3 THEN 'deprecated' ELSE 'normal' END AS rank", "CAST(NULL AS STRING) AS item_value", "p_name AS text_value", "CAST(NULL AS DOUBLE) AS amount", "CAST(NULL AS BIGINT) AS year", "CAST(NULL AS INT) AS month", "CAST(NULL AS INT) AS day", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude", "CASE p_partkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'nl' WHEN 3 THEN 'de' END AS language")
    spec = JobSpec(property="P9", template="Box", parameters=("v",), language="de", skip_any_value=False)
    rules = [constraints.Definition("Q21502410", "mandatory")]  # distinct values, which no text in a language can violate
    return evaluate_fields(*_world(spark, d, "concat('{{Box|v=', p_name, '}}')"), [Field(spec, "monolingualtext", rules)], Catalog(held)).select("page_id", "message")


_DE = {"general": {"wikiid": "dewiki", "lang": "de"}, "namespaces": {"0": {"id": 0, "name": ""}, "6": {"id": 6, "name": "Datei", "canonical": "File"}, "10": {"id": 10, "name": "Vorlage", "canonical": "Template", "case": "first-letter"}, "14": {"id": 14, "name": "Kategorie", "canonical": "Category"}}, "namespacealiases": []}


@query("""SELECT p_partkey AS page_id, concat(CAST(1930 + p_size AS STRING), '-03-0', CAST(1 + p_partkey % 9 AS STRING), '; P580: 1950-08-12') AS value,
    concat('https://de.wikipedia.org/w/index.php?title=', replace(concat(p_name, ' ', CAST(p_partkey AS STRING)), ' ', '_'), '&oldid=', CAST(p_partkey AS STRING)) AS reference, 'Q48183' AS edition
    FROM part WHERE p_brand = 'Brand#11' AND p_partkey % 5 > 0 AND p_size <= 40""")
def german_specification(spark, d):
    """From a specification of another wiki, with its names as a person types them, to statements: its months, its prefixes, its own item and host in the reference."""
    part = spark.read.parquet(f"{d}/part.parquet")
    entity = lambda p: json.dumps({"id": p, "datatype": "time", "labels": {}, "claims": {}})
    props = properties.properties(spark.createDataFrame([(entity("P569"),), (entity("P580"),)], "json string"))
    own = spark.createDataFrame([("Q48183", "P1800", "normal", "dewiki")], "item string, property string, rank string, text_value string")
    spec = JobSpec(siteid="de", property="P569", template="vorlage: brand#11", parameters=("GEBOREN",), category="Kategorie:kleine  Teile", qualifiers=(("P580", "fixed", "12 August 1950"),))
    prepared = properties.prepare(spec, props, spark.createDataFrame([], "from_title string, to_title string"), sites=spark.createDataFrame([("de.wikipedia.org", json.dumps(_DE))], "host string, info string"), claims=own)
    small = part.where("p_size <= 40").selectExpr("'Kleine_Teile' AS parent", "p_name AS child", "'page' AS kind", "p_partkey AS page_id")
    wiki = run.Wiki(view(spark, d, "fx_linktarget"), view(spark, d, "fx_templatelinks"), view(spark, d, "fx_page"), view(spark, d, "fx_page_props"), small, view(spark, d, "fx_claims"), view(spark, d, "fx_subclass"), "dewiki")
    revisions = part.selectExpr("p_partkey AS page_id", "p_partkey AS revision_id", "concat('{{Vorlage:brand#11|GEBOREN=', 1 + p_partkey % 9, '. März ', 1930 + p_size, '}}') AS text")
    out = run.outcomes(prepared, run.candidate_pages(prepared.spec, wiki, site=prepared.site), revisions, Catalog(_claims(spark, d)))
    snak = lambda p, path: F.get_json_object("statement", f"$.references[0].snaks.{p}[0].datavalue.value{path}")
    return out.where("status = 'ready'").select("page_id", "value", snak("P4656", "").alias("reference"), snak("P143", ".id").alias("edition"))


# items and classes


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 11 IN (8, 9) THEN NULL ELSE concat('Q', CAST(CASE WHEN c_custkey % 11 < 7 THEN c_custkey - c_custkey % 11 + 7 ELSE c_custkey END AS STRING)) END AS current, c_custkey % 11 NOT IN (8, 9) AS exists FROM customer""")
def merged_item_chains(spark, d):
    """Chains of up to seven merges, and circles of two."""
    q = lambda x: F.concat(F.lit("Q"), x.cast("string"))
    key, part = F.col("c_custkey"), F.col("c_custkey") % 11
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    # chains and circles are whole, also where some of their keys are in no row
    first = c.select((key - part).alias("first")).distinct()
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (*((i, i + 1) for i in range(7)), (8, 9), (9, 8))))
    whole = first.select("first", F.explode(steps).alias("s")).select(q(F.col("first") + F.col("s.a")).alias("from_item"), q(F.col("first") + F.col("s.b")).alias("to_item"))
    ends = c.select(q(key).alias("item")).union(first.select(q(F.col("first") + 7).alias("item"))).distinct()
    out = lookups.current_items(c.select(q(key).alias("item")), whole, ends)
    return out.select(F.substr("item", F.lit(2)).cast("bigint").alias("id"), "current", "exists")


@query("""SELECT p_partkey AS page_id, concat('Q', CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1000000 ELSE p_partkey END AS STRING)) AS item, CASE WHEN p_partkey % 3 = 1 THEN 'the item does not exist' END AS message FROM part""")
def evaluate_merged_items(spark, d):
    """Edits are planned for the item that the page's item was merged into, over two merges; rows without an item are errors."""
    part = spark.read.parquet(f"{d}/part.parquet")
    merged = part.where("p_partkey % 3 = 0")
    # (the item on the way has an id that no page's item has, however many parts there are)
    merges = merged.selectExpr("concat('Q', p_partkey) AS from_item", "concat('Q', p_partkey, '/2') AS to_item").union(merged.selectExpr("concat('Q', p_partkey, '/2')", "concat('Q', p_partkey + 1000000)"))
    own = part.where("p_partkey % 3 = 2").selectExpr("concat('Q', p_partkey) AS item")
    # from a million parts on, the end of a chain has the id of a page's item that doesn't exist, so these pages are on a wiki of their own
    out = None
    for keep, there in (("p_partkey % 3 <> 1", own.union(merged.selectExpr("concat('Q', p_partkey + 1000000)"))), ("p_partkey % 3 = 1", own)):
        some = evaluate_fields(*_world(spark, d, "concat('{{Box|v=', p_name, '}}')", keep), [Field(JobSpec(property="P9", template="Box", parameters=("v",)), "string")], Catalog(_claims(spark, d), merges=merges, items=there))
        out = some if out is None else out.unionByName(some)
    return out.select("page_id", "item", "message")


@query("""WITH k AS (SELECT min(p_type) AS kind FROM part), c AS (SELECT item, brand, page_id % 3 AS way FROM fx_page WHERE item IS NOT NULL)
    SELECT DISTINCT c.item FROM c WHERE c.way <> 1 AND EXISTS (SELECT 1 FROM fx_subclass s, k WHERE s.child = c.brand AND s.parent = k.kind)""")
def class_members_by_rank(spark, d):
    """Statements of the best rank count: a deprecated one and a normal one beside a preferred one don't."""
    page = view(spark, d, "fx_page").where("item IS NOT NULL").withColumn("way", F.col("page_id") % 3)
    kind = page.agg(F.min("kind")).first()[0]
    typed = page.select("item", F.lit("P31").alias("property"), F.when(F.col("way") == 1, "deprecated").otherwise("normal").alias("rank"), F.col("brand").alias("item_value"))
    # the third kind has a deprecated statement of no class as well
    typed = typed.unionByName(page.where("way = 2").select("item", F.lit("P31").alias("property"), F.lit("deprecated").alias("rank"), F.lit("nothing").alias("item_value")))
    return closure.in_classes(page.select("item"), typed, view(spark, d, "fx_subclass"), [kind]).distinct()


@query("""WITH RECURSIVE g AS (SELECT (p_size % 3) AS k, min(p_type) AS node FROM part GROUP BY p_size % 3), down AS (SELECT k, node FROM g UNION SELECT down.k, s.child FROM down JOIN fx_subclass s ON s.parent = down.node)
    SELECT node, CAST(sum(1 << k) AS BIGINT) AS groups FROM down GROUP BY node""")
def classes_below_many(spark, d):
    """One walk from several groups of classes at once."""
    part = spark.read.parquet(f"{d}/part.parquet")
    groups = [[r["t"]] for r in part.groupBy((F.col("p_size") % 3).alias("k")).agg(F.min("p_type").alias("t")).orderBy("k").collect()]
    return closure.reached(groups, view(spark, d, "fx_subclass").select(F.col("parent").alias("src"), F.col("child").alias("dst")))


# statements by property and item, and by property and value


def _laid(spark, d):
    return K.lay_out(view(spark, d, "fx_claims").select("item", "property", "rank", "item_value", "text_value"), 8)


def _asked(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.selectExpr("p_partkey AS row_id", "concat('Q', p_partkey) AS item", "'P1' AS property", "CASE WHEN p_partkey % 2 = 0 THEN concat('Q', p_partkey % 997) END AS v_item", "CASE WHEN p_partkey % 2 = 1 THEN concat('tt', p_partkey % 401) END AS v_text")


@query("SELECT p_partkey AS row_id FROM part WHERE EXISTS (SELECT 1 FROM fx_claims c WHERE c.item = concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P1' AND c.rank <> 'deprecated')")
def laid_out_single_value(spark, d):
    return constraints.single_value(_asked(spark, d), _laid(spark, d).by_item)


@query("""SELECT p_partkey AS row_id FROM part WHERE EXISTS (SELECT 1 FROM fx_claims c WHERE c.item <> concat('Q', CAST(p_partkey AS STRING)) AND c.property = 'P1'
    AND CASE WHEN p_partkey % 2 = 0 THEN c.item_value = concat('Q', CAST(p_partkey % 997 AS STRING)) ELSE c.text_value = concat('tt', CAST(p_partkey % 401 AS STRING)) END)""")
def laid_out_distinct_values(spark, d):
    table = _laid(spark, d)
    return constraints.distinct_values(_asked(spark, d), table.by_item, table.by_value, send=True)


@query("""WITH t AS (SELECT * FROM (SELECT *, max(CASE WHEN rank = 'preferred' THEN 1 ELSE 0 END) OVER (PARTITION BY item) AS top FROM fx_claims WHERE property = 'P1' AND rank <> 'deprecated') WHERE top = 0 OR rank = 'preferred')
    SELECT p_partkey AS row_id FROM part WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.item = concat('Q', CAST(p_partkey % 997 AS STRING)) AND t.item_value = concat('Q', CAST(p_partkey AS STRING)))""")
def laid_out_symmetric(spark, d):
    return constraints.inverse(_asked(spark, d), _laid(spark, d).by_item)


# runs, stores and sources


@query("""SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 = 0 THEN 'pending' WHEN p_partkey % 3 = 0 THEN 'error' ELSE 'ready' END AS status, CASE WHEN p_partkey % 5 > 0 AND p_partkey % 3 = 0 THEN 'Q9' ELSE concat('Q', CAST(p_partkey AS STRING)) END AS item FROM part""")
def run_store_batches(spark, d):
    """Batches that are written twice count once; of several outcomes of a row the latest counts."""
    store = RunStore(spark, scratch(spark, "run-store"))
    part = spark.read.parquet(f"{d}/part.parquet")
    rows = part.selectExpr("p_partkey AS seq", "p_partkey AS page_id", "p_name AS title", "concat('Q', p_partkey) AS item", "0 AS field")
    for number in (0, 1, 1):
        store.add_rows(1, rows.where(f"seq % 2 = {number}"), number)
    done = rows.where("seq % 5 > 0").select("seq", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("item"))
    for _ in range(2):
        store.add_outcomes(1, done, 0)
    store.add_outcomes(1, done.where("seq % 3 = 0").select("seq", F.lit("error").alias("status"), F.lit("Q9").alias("item")), 1)
    return store.rows(1).select("seq", "status", "item")


@query("""SELECT p_partkey AS page_id, concat(p_name, ' ', CAST(p_partkey AS STRING)) AS title, CASE WHEN p_partkey % 5 > 0 THEN concat('Q', CAST(p_partkey AS STRING)) END AS item,
    CASE WHEN p_size > 20 THEN 'not_in_category' WHEN p_partkey % 5 = 0 THEN 'no_item' END AS reason FROM part WHERE p_brand IN ('Brand#11', 'Brand#12')""")
def candidates_of_a_dump(spark, d):
    """Pages are written as an XML dump and read back by byte ranges; templates, a redirect to one, and a tree of categories come from their markup."""
    part = spark.read.parquet(f"{d}/part.parquet")
    body = F.concat(F.lit("<b>x</b> & {{"), F.lower(F.substring("p_brand", 1, 1)), F.substring("p_brand", 2, 99), F.lit("|a={{Other}}}} <!-- {{Brand#11}} -->\n[[category: size "), F.col("p_size").cast("string"), F.lit("|key]]"))
    own = part.select(F.col("p_partkey").alias("page_id"), F.lit(0).alias("namespace"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("redirect"), F.col("p_partkey").alias("revision_id"), body.alias("text"))
    more = spark.createDataFrame([(9_000_001, 10, "Template:Brand#12", "Template:Brand#11", 1, "#REDIRECT [[Template:Brand#11]]")] + [(9_000_100 + i, 14, f"Category:Size {i}", None, 1, "[[Category:Small]]" if i <= 20 else "") for i in range(51)], "page_id bigint, namespace int, title string, redirect string, revision_id bigint, text string")
    path = scratch(spark, "dump")
    pages.write_dump(own.unionByName(more), path)
    items = part.where("p_partkey % 5 > 0").selectExpr("p_partkey AS page_id", "concat('Q', p_partkey) AS item")
    wiki = pages.tables_of_dump(spark, path, items, view(spark, d, "fx_claims").select("item", "property", "rank", "item_value"), view(spark, d, "fx_subclass"), "enwiki")
    spec = JobSpec(property="P99", template="Brand#11", parameters=("a",), category="small", depth=1, skip_any_value=False)
    source = pages.WithFallback((pages.TableSource(wiki),))
    return run.candidate_pages(spec, wiki, source=source).select("page_id", "title", "item", "reason")


@query("SELECT 'total' AS status, count(*) AS n FROM fx_run_row UNION ALL SELECT s.status, count(r.seq) FROM (VALUES ('pending'), ('ready'), ('done'), ('skipped'), ('error')) AS s(status) LEFT JOIN fx_run_row r ON s.status = CASE WHEN r.status = 'lost' THEN 'error' ELSE r.status END GROUP BY s.status")
def counts_on_the_way(spark, d):
    """Counts that are taken while the rows are written."""
    rows, seen = results.observed(view(spark, d, "fx_run_row").select("run_id", "seq", "status"), "rows")
    rows.write.parquet(scratch(spark, "observed"))
    return spark.createDataFrame(sorted(seen.get.items()), "status string, n bigint")


@query("""SELECT p_partkey AS page_id FROM part WHERE p_brand = 'Brand#11'""")
def pages_of_the_second_source(spark, d):
    """The first source fails while its plan runs; the second one answers."""

    class Down:
        def transclusions(self, template, namespace):
            return spark.read.parquet(f"{d}/part.parquet").select(F.raise_error(F.lit("no replica")).alias("page_id"))

    wiki = run.Wiki(view(spark, d, "fx_linktarget"), view(spark, d, "fx_templatelinks"), view(spark, d, "fx_page"), view(spark, d, "fx_page_props"), view(spark, d, "fx_categorylinks"), view(spark, d, "fx_claims"), view(spark, d, "fx_subclass"), "enwiki")
    return pages.WithFallback((Down(), pages.TableSource(wiki))).transclusions("Brand#11", 0).select("page_id")


@query("SELECT concat(lower(n_name), 'wiki') AS dbname, concat('Q', CAST(min(c_custkey) AS STRING)) AS item FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0 AND length(CAST(c_custkey AS STRING)) = 2 GROUP BY n_name")
def editions_of_wikis(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).where("length(c_custkey) = 2")
    claims = c.selectExpr("concat('Q', c_custkey) AS item", "'P1800' AS property", "CASE WHEN c_custkey % 3 = 0 THEN 'deprecated' ELSE 'normal' END AS rank", "concat(lower(n_name), 'wiki') AS text_value")
    return lookups.editions(claims)


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'commons.wikimedia.org' WHEN 1 THEN concat('x', CAST(n_nationkey AS STRING), '-a.wikipedia.org') WHEN 2 THEN concat('x', CAST(n_nationkey AS STRING), '-a.wiktionary.org') END AS host FROM nation""")
def hosts_of_wikis(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    code = F.concat(F.lit("x"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 5 == 3, "/evil").otherwise("-a"))
    project = F.element_at(F.array(*map(F.lit, ("commons", "wikipedia", "wiktionary", "wikipedia", "example"))), F.col("n_nationkey").cast("int") % 5 + 1)
    return n.select("n_nationkey", lookups.host_of(code, project).alias("host"))


@query("SELECT o_orderkey, month(o_orderdate)::INT AS short, month(o_orderdate)::INT AS long, month(o_orderdate)::INT AS roman, month(o_orderdate)::INT AS german FROM orders")
def month_names(spark, d):
    """Names of months, their first three letters, Roman numerals, and those of another language."""
    named = N.month_names(spark, ["en", "de"])
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", F.month("o_orderdate").alias("m"))
    german = F.element_at(F.array(*(F.lit(max((k for k, v in named["de"].items() if v == i), key=len)) for i in range(1, 13))), F.col("m"))
    return o.select(
        "o_orderkey", N.month_number(F.date_format("o_orderdate", "MMM"), named["en"]).alias("short"), N.month_number(F.upper(F.date_format("o_orderdate", "MMMM")), named["en"]).alias("long"),
        N.month_number(F.element_at(F.array(*map(F.lit, N.ROMAN)), F.col("m"))).alias("roman"), N.month_number(german, named["de"]).alias("german"),
    )


@query("SELECT p_partkey, concat('<nowiki>|b=', p_name, '}}</nowiki>', p_brand) AS a, CAST(p_size AS STRING) AS c FROM part")
def nowiki_hides_signs(spark, d):
    rows = _rendered(spark, d, "{{X|a=<nowiki>|b=%p_name%}}</nowiki>%p_brand%|c=%p_size%}}")
    p = rows.select("p_partkey", W.template_params(F.col("wikitext"), ["X"]).alias("p"))
    return p.select("p_partkey", *(W.first_of(F.col("p"), [n]).alias(n) for n in "ac"))


@query("""SELECT p_partkey AS page_id, concat_ws(' / ', CAST(1930 + p_size AS STRING), CASE WHEN p_partkey % 3 > 0 THEN CAST(1 + p_partkey % 12 AS STRING) END, CASE WHEN p_partkey % 3 = 2 THEN '7' END) AS raw_value,
    concat(CAST(1930 + p_size AS STRING), CASE WHEN p_partkey % 3 > 0 THEN concat('-', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0')) ELSE '' END, CASE WHEN p_partkey % 3 = 2 THEN '-07' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN ' (Julian)' ELSE '' END) AS value FROM part""")
def evaluate_dates_in_parts(spark, d):
    """What was found is shown by its parts, the date as precise as it is and with its calendar."""
    text = "concat('{{Box|y=', 1930 + p_size, CASE WHEN p_partkey % 3 > 0 THEN concat('|m=', 1 + p_partkey % 12) ELSE '|m= ' END, CASE WHEN p_partkey % 3 = 2 THEN '|d=<!-- x -->7' ELSE '' END, '}}')"
    out = None
    for k in (0, 1):
        spec = JobSpec(property="P9", template="Box", date_parameters=("y", "m", "d"), date_limit=None, julian=k == 0)
        part = evaluate_fields(*_world(spark, d, text, f"p_partkey % 2 = {k}"), [Field(spec, "time")], Catalog(_claims(spark, d))).select("page_id", "raw_value", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'the item already has this value' END AS message FROM part""")
def evaluate_dates_by_precision(spark, d):
    """An existing date is the same if it is as precise as ours or more, and agrees as far as ours goes."""
    part = spark.read.parquet(f"{d}/part.parquet")
    held = part.selectExpr("concat('Q', p_partkey) AS item", "'P9' AS property", "'normal' AS rank", "CAST(NULL AS STRING) AS item_value", "CAST(NULL AS STRING) AS text_value", "CAST(NULL AS DOUBLE) AS amount", "1950L AS year", "CASE WHEN p_partkey % 4 = 3 THEN 6 ELSE 5 END AS month", "4 AS day", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude", "CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN 10 WHEN 2 THEN 9 ELSE 11 END AS precision")
    spec = JobSpec(property="P9", template="Box", parameters=("v",), skip_any_value=False)
    return evaluate_fields(*_world(spark, d, "'{{Box|v=May 1950}}'"), [Field(spec, "time")], Catalog(held)).select("page_id", "message")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('Part ', CAST(s_suppkey AS STRING)) ELSE concat('Category:Part ', CAST(s_suppkey AS STRING)) END AS title FROM supplier")
def full_titles(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    space = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("Category")
    return s.select("s_suppkey", T.full_title(space, F.concat(F.lit("Part_"), F.col("s_suppkey").cast("string"))).alias("title"))


@query("""SELECT c_custkey AS id, concat('P', CAST(c_custkey AS STRING)) AS property, concat('Box & ', c_name) AS template, CASE WHEN c_custkey % 2 = 0 THEN '["a","b c"]' ELSE '["1"]' END AS parameters,
    CASE WHEN c_custkey % 3 = 0 THEN '[1582,10,15]' WHEN c_custkey % 3 = 1 THEN '[1926,0,0]' END AS date_limit, CASE WHEN c_custkey % 5 = 0 THEN '[["P580","param","from,since"]]' ELSE '[]' END AS qualifiers, true AS same FROM customer""")
def permalinks_and_specifications(spark, d):
    """Old shares keep permalinks: each is read into a specification and written again, and reads the same."""
    c, key = spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey")
    link = F.concat(
        F.lit("siteid=de&project=wikipedia&p="), key.cast("string"), F.lit("&template=Box%20%26%20"), F.col("c_name"), F.when(key % 2 == 0, "&parameters=a|b%20c").otherwise("&parameter=1"),
        F.when(key % 3 == 0, "&limityear=1582-10-15&rel=l").when(key % 3 == 1, "").otherwise("&limityear=none"), F.when(key % 5 == 0, "&qualifier=P580|param|from, since").otherwise("&unknown=7"),
    )
    from tessera.plans import job

    rows = spread(c.select("c_custkey", link.alias("link")), "c_custkey").select("c_custkey", job.specs_of(F.col("link")).alias("spec"))
    rows = rows.withColumn("again", job.specs_of(job.permalinks_of(F.col("spec"))))
    of = lambda name: F.get_json_object("spec", f"$.{name}")
    return rows.select(key.alias("id"), *(of(n).alias(n) for n in ("property", "template", "parameters", "date_limit", "qualifiers")), (F.col("spec") == F.col("again")).alias("same"))


@query("SELECT CAST(p_partkey AS STRING) AS page_id, concat(p_name, ' \"', p_brand, '\"') AS title, CASE WHEN p_partkey % 2 = 0 THEN concat('Q', CAST(p_partkey AS STRING)) ELSE '' END AS item, 'done' AS status, concat('a, b; ', p_type) AS raw_value, '' AS value, concat('line', chr(10), p_type) AS message FROM part")
def csv_log(spark, d):
    """The log as a spreadsheet reads it: quotes doubled, commas and line breaks inside."""
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS seq", "p_partkey AS page_id", "concat(p_name, ' \"', p_brand, '\"') AS title", "CASE WHEN p_partkey % 2 = 0 THEN concat('Q', p_partkey) END AS item", "'done' AS status", "concat('a, b; ', p_type) AS raw_value", "CAST(NULL AS STRING) AS value", "concat('line\n', p_type) AS message")
    path = scratch(spark, "log")
    results.write_log(rows, path)
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in results.LOG_COLUMNS))


@query("""SELECT p_partkey AS page_id, 0 AS field, p_name AS value FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, 1, concat(CAST(1930 + p_size AS STRING), '-06') FROM part WHERE p_partkey % 5 > 0""")
def specification_with_extra_properties(spark, d):
    """A permalink with an extra property: prepared, and both fields read in one pass; a template's redirects that weren't chosen are other templates."""
    from tessera.plans import job

    entity = lambda p, kind: json.dumps({"id": p, "datatype": kind, "labels": {}, "claims": {}})
    props = properties.properties(spark.createDataFrame([(entity("P91", "string"),), (entity("P92", "time"),)], "json string"))
    redirects = spark.createDataFrame([("Part_box", "Box"), ("Old box", "Box")], "from_title string, to_title string")
    spec = job.from_query("siteid=en&project=wikipedia&p=91&template=box&templateredirects=Part box&parameters=a&also=P92|c&skipremoved=0")
    prepared = properties.prepare(spec, props, redirects)
    text = "concat('{{Old box|a=wrong}} {{part_box|a=', p_name, '|c=June ', 1930 + p_size, '}}')"
    rows, revisions = _world(spark, d, text, "p_partkey % 5 > 0")
    out = run.outcomes(prepared, rows.withColumn("reason", F.lit(None).cast("string")), revisions, Catalog(_claims(spark, d)))
    return out.select("page_id", "field", "value")
