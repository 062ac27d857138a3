"""What needs more than one field, a wiki of its own, ranks, languages or large claims: outcomes, and the plans behind them."""

import json
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.operators import claims as K
from tessera.operators import closure
from tessera.operators import constraints as C
from tessera.plans import properties, run
from tessera.plans.evaluate import Catalog, Field, drafts, evaluate_fields
from tessera.plans.job import InvalidSpec, JobSpec
from tessera.sources import lookups

CLAIMS = "item string, property string, rank string, item_value string, text_value string, amount double, unit string, year bigint, month int, day int, latitude double, longitude double, language string"


def claim(item, prop, rank="normal", value=None, text=None, language=None):
    return (item, prop, rank, value, text, None, None, None, None, None, None, None, language)


def world(spark, texts, rows=(), **more):
    pages = spark.createDataFrame([(i, f"Page {i}", f"Q{i}") for i in range(1, len(texts) + 1)], "page_id bigint, title string, item string")
    revisions = spark.createDataFrame([(i, 100 + i, t) for i, t in enumerate(texts, 1)], "page_id bigint, revision_id bigint, text string")
    return pages, revisions, Catalog(spark.createDataFrame(list(rows), CLAIMS), **more)


def got(spark, texts, fields, rows=(), **more):
    out = evaluate_fields(*world(spark, texts, rows, **more)[:2], fields, world(spark, texts, rows, **more)[2])
    return {(r["page_id"], r["field"]): r for r in out.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_unit_in_the_text_wins(spark):
    units = spark.createDataFrame([("g", "Q41803"), ("gram", "Q41803"), ("kg", "Q11570")], "name string, unit string")
    spec = JobSpec(property="P1", template="Box", parameters=("v",), unit="Q11570")
    texts = ["{{Box|v=82 g}}", "{{Box|v=82}}", "{{Box|v=82 parsecs}}", "{{Box|v=1,500 Kg.}}", "{{Box|v=about}}"]
    out = got(spark, texts, [Field(spec, "quantity")], units=units)
    assert [(out[i, 0]["value"], out[i, 0]["message"]) for i in range(1, 6)] == [("+82 Q41803", None), ("+82 Q11570", None), (None, "unknown unit 'parsecs'"), ("+1500 Q11570", None), (None, "unclear number")]
    # each field has its own names of units
    more = Field(replace(spec, property="P2", parameters=("w",), unit=None), "quantity", units=spark.createDataFrame([("g", "Q9")], "name string, unit string"))
    both = got(spark, ["{{Box|v=1 g|w=2 g}}", "{{Box|v=1|w=2 kg}}"], [Field(spec, "quantity"), more], units=units)
    assert [both[k]["value"] for k in ((1, 0), (1, 1), (2, 0))] == ["+1 Q41803", "+2 Q9", "+1 Q11570"] and both[2, 1]["message"] == "unknown unit 'kg'"


def test_texts_match_in_their_language(spark):
    spec = JobSpec(property="P1", template="Box", parameters=("v",), language="de", skip_any_value=False)
    rows = [claim("Q1", "P1", text="Hund", language="de"), claim("Q2", "P1", text="Hund", language="nl"), claim("Q3", "P1", text="Hund")]
    out = got(spark, ["{{Box|v=Hund}}"] * 4, [Field(spec, "monolingualtext", [C.Definition("Q21502410"), C.Definition("Q21510852")])], rows, world=C.World(None or spark.createDataFrame(rows, CLAIMS), pages=spark.createDataFrame([], "namespace string, title string")))
    assert [out[i, 0]["message"] for i in range(1, 5)] == ["the item already has this value", None, None, None]  # neither distinct values nor a link to Commons is asked of it


def test_best_ranks_make_members(spark):
    typed = spark.createDataFrame([("Q1", "P31", "deprecated", "A"), ("Q1", "P31", "normal", "X"), ("Q2", "P31", "normal", "A"), ("Q3", "P31", "normal", "A"), ("Q3", "P31", "preferred", "X"), ("Q4", "P31", "preferred", "B")], "item string, property string, rank string, item_value string")
    below = spark.createDataFrame([("B", "A")], "child string, parent string")
    items = typed.select("item").distinct()
    assert {r["item"] for r in closure.in_classes(items, typed, below, ["A"]).collect()} == {"Q2", "Q4"}
    rows = items.select(F.substr("item", F.lit(2)).cast("long").alias("row_id"), "item", F.lit("Q2").alias("v_item"))
    assert {r["row_id"] for r in C.type_(rows, typed, below, ["A"]).collect()} == {1, 3}


def test_one_walk_for_many_classes(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("c", "d"), ("y", "z")], "src string, dst string")
    masks = {r["node"]: r["groups"] for r in closure.reached([["a"], ["x", "y"], ["none"]], edges).collect()}
    assert masks == {"a": 3, "b": 3, "c": 3, "d": 3, "x": 2, "y": 2, "z": 2, "none": 4}
    for i, seeds in enumerate((["a"], ["x", "y"], ["none"])):
        alone = {r["node"] for r in closure.closure(spark.createDataFrame([(s,) for s in seeds], "node string"), edges).collect()}
        assert alone == {n for n, m in masks.items() if m >> i & 1}
    # four rules about classes, one walk
    walks = []
    real = closure.reached
    monkeypatch.setattr(C, "reached", lambda *a: walks.append(1) or real(*a))
    monkeypatch.setattr(C, "in_classes", lambda *a: (_ for _ in ()).throw(AssertionError("a walk of its own")))
    subclass = spark.createDataFrame([("Q11", "Q10"), ("Q21", "Q20"), ("Q31", "Q30")], "child string, parent string")
    rows = [claim("Q1", "P31", value="Q11"), claim("Q2", "P31", value="Q21"), claim("Q7", "P31", value="Q31")]
    rules = [C.Definition(k, "mandatory", {"P2308": c}) for k, c in (("Q21503250", ["Q10", "Q20"]), ("Q21503250", ["Q10"]), ("Q21510865", ["Q30"]), ("Q21510865", ["Q20"]))]
    known = spark.createDataFrame([("Seven", "Q7"), ("Two", "Q2")], "title string, item string")
    spec = JobSpec(property="P9", template="Box", parameters=("v",))
    out = got(spark, ["{{Box|v=[[Seven]]}}", "{{Box|v=[[Seven]]}}"], [Field(spec, "wikibase-item", rules)], rows, link_targets=known, world=C.World(spark.createDataFrame(rows, CLAIMS), subclass=subclass))
    assert [out[i, 0]["message"] for i in (1, 2)] == ["constraint violation: value type", "constraint violation: type"] and len(walks) == 1


def test_rows_leave_after_a_violation(spark):
    """Rows that meet the last of three joined rules: those that have violated neither of the two before, and only their own field's."""
    met = []

    def joins(name, bad):
        def rule(rows, claims):
            ids = rows.where(F.col("value").isin(*bad)).select("row_id")
            met.append((name, sorted(r["value"] for r in rows.collect())))
            return ids

        return name, rule

    rules = [joins("one", ["a"]), ("short", lambda rows, claims: F.length("v_text") > 1), joins("two", ["b", "cc"]), joins("three", ["a", "b", "d"])]
    spec = JobSpec(property="P1", template="Box", parameters=("v",))
    fields = [Field(spec, "string", rules), Field(replace(spec, property="P2", parameters=("w",)), "string")]
    out = got(spark, ["{{Box|v=a|w=z}}", "{{Box|v=b}}", "{{Box|v=cc}}", "{{Box|v=d}}", "{{Box|v=e}}"], fields)
    assert [out[i, 0]["message"] for i in range(1, 6)] == ["constraint violation: one", "constraint violation: two", "constraint violation: short", "constraint violation: three", None]
    assert out[1, 1]["message"] is None
    assert dict(met) == {"one": ["a", "b", "cc", "d", "e"], "two": ["b", "d", "e"], "three": ["d", "e"]}


def test_pages_are_read_once_whatever_the_fields(spark):
    spec = JobSpec(property="P1", template="Box", parameters=("a",))
    fields = [Field(replace(spec, property=f"P{i}", parameters=(p,)), kind) for i, (p, kind) in enumerate((("a", "string"), ("b", "external-id"), ("c", "time"), ("d", "quantity"), ("e", "url")))]
    pages, revisions, catalog = world(spark, ["{{Box|a=x|b=y|c=4 May 1999|d=7|e=http://a.org}}", "{{Box|a=z}}"])
    count = lambda n: (len(re.findall(r"ArrowEvalPython|MapInPandas|BatchEvalPython", p := plan_of(drafts(pages, revisions, fields[:n], catalog)))), len(re.findall(r"(?:Scan|LocalTableScan)[^\n]*revision_id", p)))
    assert count(1) == count(4) == count(5) == (1, 1)
    out = {(r["page_id"], r["field"]): (r["value"], r["message"]) for r in evaluate_fields(pages, revisions, fields, catalog).collect()}
    assert [out[1, i][0] for i in range(5)] == ["x", "y", "1999-05-04", "+7", "http://a.org"] and [out[2, i][1] for i in range(5)] == [None] + ["no value"] * 4


def test_runs_of_any_length_and_numerals(spark):
    spec = JobSpec(property="P1", template="Box", parameters=("1",))
    long = "{{Box|" + "|".join(["52", "31"] + ["x"] * 15) + "}}"
    texts = ["{{Box|52|31|N|13|24|E}}", "{{Box|1={{coord|٥٢|٣١|N|١٣|٢٤|E|type:city}}}}", "{{Box|52.5|13.4}}", long, "{{Box|1={{Coord|52|13|scale:5}}}}"]
    out = got(spark, texts, [Field(spec, "globe-coordinate")])
    assert [out[i, 0]["value"] for i in range(1, 6)] == ["52.52, 13.40", "52.52, 13.40", "52.5, 13.4", "52, 31", "52, 13"]
    assert out[4, 0]["raw_value"].count(" ") == 16  # no value of the run is left out
    links = spark.createDataFrame([("Paris", "Q90")], "title string, item string")
    item = got(spark, ["{{Box|1=[[Paris}}"], [Field(spec, "wikibase-item")], link_targets=links)
    assert item[1, 0]["value"] == "Q90"  # a link that isn't closed


def test_chains_of_merged_items(spark):
    merges = spark.createDataFrame([("Q1", "Q2"), ("Q2", "Q3"), ("Q5", "Q6"), ("Q6", "Q5"), ("Q7", "Q5"), ("Q8", "Q8")] + [(f"Q{i}", f"Q{i + 1}") for i in range(100, 137)], "from_item string, to_item string")
    items = spark.createDataFrame([(f"Q{i}",) for i in (1, 2, 3, 4, 5, 7, 8, 9, 100)], "item string")
    there = spark.createDataFrame([("Q3",), ("Q4",), ("Q137",)], "item string")
    out = {r["item"]: (r["current"], r["exists"]) for r in lookups.current_items(items, merges, there).collect()}
    assert out == {"Q1": ("Q3", True), "Q2": ("Q3", True), "Q3": ("Q3", True), "Q4": ("Q4", True), "Q5": (None, False), "Q7": (None, False), "Q8": (None, False), "Q9": ("Q9", False), "Q100": ("Q137", True)}
    # the edit is planned for the last item, against what that one has
    spec = JobSpec(property="P1", template="Box", parameters=("v",), skip_any_value=False)
    done = got(spark, ["{{Box|v=x}}", "{{Box|v=y}}", "{{Box|v=z}}", "{{Box|v=w}}", "{{Box|v=w}}"], [Field(spec, "string")], [claim("Q3", "P1", text="y")], merges=merges, items=there)
    assert [(done[i, 0]["item"], done[i, 0]["message"]) for i in range(1, 6)] == [("Q3", None), ("Q2", "the item already has this value"), ("Q3", None), ("Q4", None), ("Q5", "the item does not exist")]


GERMAN = {"general": {"wikiid": "dewiki", "lang": "de"}, "namespaces": {"0": {"id": 0, "name": ""}, "6": {"id": 6, "name": "Datei", "canonical": "File"}, "10": {"id": 10, "name": "Vorlage", "canonical": "Template", "case": "first-letter"}, "14": {"id": 14, "name": "Kategorie", "canonical": "Category"}}, "namespacealiases": [{"id": 6, "alias": "Bild"}]}


@pytest.fixture(scope="module")
def german(spark):
    entity = lambda p, kind, **more: json.dumps({"id": p, "datatype": kind, "labels": {}, "claims": more})
    props = properties.properties(spark.createDataFrame([(entity("P569", "time"),), (entity("P580", "time"),), (entity("P854", "url"),), (entity("P2", "wikibase-item"),), (entity("P3", "string"),)], "json string"))
    sites = spark.createDataFrame([("de.wikipedia.org", json.dumps(GERMAN)), ("fr.wiktionary.org", json.dumps(GERMAN | {"general": {"wikiid": "frwiktionary", "lang": "fr"}, "namespaces": {"10": {"id": 10, "name": "Modèle", "canonical": "Template", "case": "case-sensitive"}}}))], "host string, info string")
    own = spark.createDataFrame([("Q48183", "P1800", "normal", "dewiki")], "item string, property string, rank string, text_value string")
    redirects = spark.createDataFrame([("Person_info", "Personendaten")], "from_title string, to_title string")
    return lambda spec: properties.prepare(spec, props, redirects, templates=spark.createDataFrame([("Personendaten",), ("voir",)], "title string"), sites=sites, claims=own)


def test_a_german_specification_end_to_end(spark, german):
    spec = JobSpec(siteid="de", property="P569", template="vorlage: personendaten", parameters=("GEBURTSDATUM",), category="Kategorie:mann  X", qualifiers=(("P580", "fixed", "12 August 1950"), ("P854", "fixed", "https://archive.is/x")), date_limit=None, skip_any_value=False)
    prepared = german(spec)
    assert (prepared.site.dbname, prepared.site.language, prepared.site.edition, prepared.site.template_prefixes) == ("dewiki", "de", "Q48183", ("Vorlage", "Template"))
    t = spark.createDataFrame
    wiki = run.Wiki(
        t([(1, 10, "Personendaten")], "lt_id int, namespace int, title string"), t([(7, 0, 1), (8, 0, 1), (9, 0, 1)], "from_id bigint, from_namespace int, target_id int"), t([(i, 0, f"S {i}", i) for i in (7, 8, 9)], "page_id bigint, namespace int, title string, latest_revision bigint"),
        t([(i, "wikibase_item", f"Q{i}") for i in (7, 8, 9)], "page_id bigint, name string, value string"), t([("Mann_X", "S", "page", 7), ("Mann_X", "S", "page", 8)], "parent string, child string, kind string, page_id bigint"), t([], CLAIMS), t([], "child string, parent string"), "dewiki",
    )
    marked = run.candidate_pages(prepared.spec, wiki, site=prepared.site)
    assert {r["page_id"]: r["reason"] for r in marked.collect()} == {7: None, 8: None, 9: "not_in_category"}
    revisions = t([(7, 70, "{{Person info|GEBURTSDATUM=3. März 1999}}"), (8, 80, "{{Vorlage:Personendaten|GEBURTSDATUM=Mai 1950}}"), (9, 90, "")], "page_id bigint, revision_id bigint, text string")
    out = {r["page_id"]: r for r in run.outcomes(prepared, marked, revisions, Catalog(t([], CLAIMS))).collect()}
    assert (out[7]["value"], out[8]["value"]) == ("1999-03-03; P580: 1950-08-12; P854: https://archive.is/x", "1950-05; P580: 1950-08-12; P854: https://archive.is/x")
    statement = json.loads(out[7]["statement"])
    snaks = statement["references"][0]["snaks"]
    assert snaks["P4656"][0]["datavalue"]["value"] == "https://de.wikipedia.org/w/index.php?title=S_7&oldid=70" and snaks["P143"][0]["datavalue"]["value"]["id"] == "Q48183"
    assert statement["qualifiers"]["P580"][0]["datavalue"]["value"]["time"] == "+1950-08-12T00:00:00Z"


def test_case_sensitive_wikis(spark, german):
    prepared = german(JobSpec(siteid="fr", project="wiktionary", property="P3", template="Modèle:voir", parameters=("1",)))
    assert not prepared.site.first_letter and prepared.site.key("modèle:voir x", 10) == "voir_x"
    pages, revisions, catalog = world(spark, ["{{voir|a}}", "{{Voir|b}}"])
    out = {r["page_id"]: r["message"] for r in run.outcomes(prepared, pages.withColumn("reason", F.lit(None).cast("string")), revisions, catalog).collect()}
    assert out == {1: None, 2: "template not found"}


@pytest.mark.parametrize("change, says", [({"qualifiers": (("P580", "fixed", "not a date"),)}, "is no value"), ({"qualifiers": (("P2", "fixed", "Q0"),)}, "is no value"), ({"qualifiers": (("P854", "fixed", "x y"),)}, "is no value"), ({"items_sql": "SELECT 1 AS x"}, "column item"), ({"value_pattern": "abc"}, "parameter"), ({"search": "(a+)+$"}, "too many ways"), ({"siteid": "xx"}, "cannot reach"), ({"template": " "}, "no template")])
def test_checks_before_the_run(german, change, says):
    with pytest.raises(InvalidSpec, match=says):
        german(replace(JobSpec(siteid="de", property="P3", template="Personendaten", parameters=("x",)), **change))


@pytest.fixture(scope="module")
def table(spark):
    rows = [claim(f"Q{i % 400}", f"P{i % 7}", ("normal", "preferred", "deprecated")[i % 3], value=f"Q{i % 50}" if i % 2 else None, text=None if i % 2 else f"t{i % 90}") for i in range(3_000)]
    claims = spark.createDataFrame(rows, CLAIMS).repartition(3)
    out = K.lay_out(claims, 4)
    yield claims, out
    out.drop()


@pytest.mark.parametrize("send", [True, False])
@pytest.mark.parametrize("name", ["single value", "single best value", "distinct values", "symmetric", "inverse", "value requires statement"])
def test_laid_out_claims_are_not_moved(spark, table, name, send):
    """Joins with the rows' keys sent to the statements, and joins on the layout's own buckets: no exchange of statements in the plan, and the same rows as over plain claims."""
    claims, laid = table
    rows = spark.createDataFrame([(i, f"Q{i}", f"P{i % 7}", f"Q{i % 50}" if i % 2 else None, None if i % 2 else f"t{i}") for i in range(90)], "row_id bigint, item string, property string, v_item string, v_text string")
    rules = {
        "single value": lambda c, v, s: C.single_value(rows, c, s), "single best value": lambda c, v, s: C.single_best_value(rows, c, s), "distinct values": lambda c, v, s: C.distinct_values(rows, c, v, s), "symmetric": lambda c, v, s: C.inverse(rows, c, None, s),
        "inverse": lambda c, v, s: C.inverse(rows, c, "P3", s), "value requires statement": lambda c, v, s: C.value_requires_statement(rows, c, "P3", None, s),
    }
    ids = lambda df: {r["row_id"] for r in df.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = rules[name](laid.by_item, laid.by_value, send)
        assert ids(found) == ids(rules[name](claims, None, None)) and len(ids(found)) > 0
        plan = plan_of(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if name in ("single value", "single best value", "distinct values", "symmetric"):
        lines = [x for x in plan.split("== Initial Plan")[0].splitlines()]
        depth = lambda x: len(re.match(r"[\s:|+\-*()0-9]*", x)[0])
        for i, line in enumerate(lines):  # from each scan of the laid-out tables upwards: no exchange before the join
            if "Scan parquet" in line and "claims_" in line:
                at = depth(line)
                for above in reversed(lines[:i]):
                    if depth(above) < at:
                        at = depth(above)
                        if "Join" in above:
                            break
                        assert "Exchange" not in above, plan
