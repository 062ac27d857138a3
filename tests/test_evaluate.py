"""Outcomes end to end, one small world for each kind of value."""

import json
import re

import pytest

from tessera.operators import constraints as C
from tessera.plans.evaluate import Catalog, evaluate, evaluate_all
from tessera.plans.job import InvalidSpec, JobSpec, as_dict, for_extra, from_dict, from_query, to_query, validate

CLAIMS = "item string, property string, rank string, item_value string, text_value string, amount double, unit string, year bigint, month int, day int, latitude double, longitude double"


@pytest.fixture(scope="module")
def catalog(spark):
    claims = spark.createDataFrame(
        [
            ("Q1", "P9", "normal", "Q90", "tt0000001", 1.5, None, 1950, 1, 2, 48.0, 2.0),
            ("Q3", "P9", "normal", "Q7", "other", 9.0, None, 1800, 0, 0, 1.0, 1.0),
        ],
        CLAIMS,
    )
    return Catalog(
        claims,
        link_targets=spark.createDataFrame([("Paris", "Q90"), ("Self", "Q2"), ("Bare", None)], "title string, item string"),
        files=spark.createDataFrame([("Foo bar.jpg", True), ("Local.png", False)], "name string, shared boolean"),
        units=spark.createDataFrame([("kg", "Q11570"), ("g", "Q41803")], "name string, unit string"),
        history=spark.createDataFrame([("Q2", 1, "/* wbremoveclaims-remove:1| */ [[Property:P9]]: tt0000009")], "item string, rev bigint, comment string"),
    )


def outcomes(spark, catalog, texts, spec, datatype, rules=()):
    """texts: (item, wikitext)"""
    pages = spark.createDataFrame([(i, f"Page {i}", item) for i, (item, _) in enumerate(texts)], "page_id bigint, title string, item string")
    revisions = spark.createDataFrame([(i, 100 + i, t) for i, (_, t) in enumerate(texts) if t is not None], "page_id bigint, revision_id bigint, text string")
    rows = evaluate(pages, revisions, spec, datatype, catalog, list(rules)).orderBy("page_id").collect()
    return [(r["status"], r["value"], r["message"]) for r in rows], rows


def test_external_id(spark, catalog):
    spec = JobSpec(property="P9", template="IMDb", parameters=("id", "1"), add_prefix="tt", skip_any_value=False)
    texts = [("Q2", "{{IMDb|id=0000002}}"), ("Q1", "{{iMDb|0000001}}"), ("Q3", "{{IMDb|5}}"), (None, "{{IMDb|5}}"), ("Q2", "none"), ("Q2", "{{IMDb|id= }}"), ("Q2", None), ("Q2", "{{IMDb|0000009}}"), ("Q2", "{{IMDb|–}}")]
    got, rows = outcomes(spark, catalog, texts, spec, "external-id", [("format", lambda r, c: C.format_(r["v_text"], "tt[0-9]{7}"))])
    assert got == [
        ("ready", "tt0000002", None), ("skipped", "tt0000001", "the item already has this value"), ("error", "tt5", "constraint violation: format"),
        ("skipped", "tt5", "the page has no Wikidata item"), ("skipped", None, "template not found"), ("skipped", None, "no value"), ("error", None, "the page no longer exists"),
        ("skipped", "tt0000009", "this value was removed from the item before"), ("skipped", None, "no value"),
    ]
    statement = json.loads(rows[0]["statement"])
    assert statement["mainsnak"]["datavalue"] == {"value": "tt0000002", "type": "string"}
    assert statement["references"][0]["snaks-order"] == ["P143", "P4656"]
    assert rows[1]["statement"] is None
    any_value, _ = outcomes(spark, catalog, texts[2:3], JobSpec(property="P9", template="IMDb", parameters=("1",)), "external-id")
    assert any_value == [("skipped", "5", "the item already has the property")]


def test_items(spark, catalog):
    spec = JobSpec(property="P19", template="Box", parameters=("place",))
    texts = [("Q2", "{{Box|place=[[paris|the city]]}}"), ("Q2", "{{Box|place=[[Self]]}}"), ("Q2", "{{Box|place=[[Bare]]}}"), ("Q2", "{{Box|place=[[Nowhere]]}}"), ("Q2", "{{Box|place=[[Paris#x]]}}"), ("Q2", "{{Box|place=Paris}}")]
    got, _ = outcomes(spark, catalog, texts, spec, "wikibase-item")
    assert [g[2] for g in got] == [None, "the link points to the page itself", "[[Bare]] has no Wikidata item", "[[Nowhere]] does not exist", "link to a section, not a page", None]
    strict, _ = outcomes(spark, catalog, texts[5:], JobSpec(property="P19", template="Box", parameters=("place",), plain_links=False), "wikibase-item")
    assert strict[0][2] == "no link to a target page"


def test_dates(spark, catalog):
    spec = JobSpec(property="P569", template="Box", parameters=("born",))
    texts = [("Q2", f"{{{{Box|born={t}}}}}") for t in ("4 July 1976", "Feb 30, 1980", "circa 1950", "1900-01-01", "May 1999", "1970", "no date")]
    got, rows = outcomes(spark, catalog, texts, spec, "time")
    assert got == [("ready", "1976-07-04", None), ("error", None, "invalid date"), ("error", None, "imprecise date"), ("error", None, "date outside the configured range"), ("ready", "1999-05", None), ("ready", "1970", None), ("error", None, "could not find a date")]
    assert json.loads(rows[0]["statement"])["mainsnak"]["datavalue"]["value"]["time"] == "+1976-07-04T00:00:00Z"
    parts = JobSpec(property="P569", template="Box", date_parameters=("y", "m", "d"), date_limit=None)
    got, _ = outcomes(spark, catalog, [("Q2", "{{Box|y=1700|m=II|d=28}}"), ("Q2", "{{Box|y=1700|m=2|d=29}}"), ("Q2", "{{Box|m=2}}"), ("Q2", "{{Box|y=x}}")], parts, "time")
    assert [g[1:] for g in got] == [("1700-02-28", None), (None, "invalid date"), (None, "no value"), (None, "could not find a date")]
    julian, _ = outcomes(spark, catalog, [("Q2", "{{Box|y=1700|m=2|d=29}}")], JobSpec(property="P569", template="Box", date_parameters=("y", "m", "d"), date_limit=None, julian=True), "time")
    assert julian[0][1] == "1700-02-29 (Julian)"


def test_other_kinds(spark, catalog):
    run = lambda text, datatype, **o: outcomes(spark, catalog, [("Q2", f"{{{{Box|v={text}}}}}")], JobSpec(property="P1", template="Box", parameters=("v",), **o), datatype)[0][0]
    assert run("1&nbsp;234.50 [[Kilogram|kg]]", "quantity")[1:] == (None, "unknown unit '[[Kilogram]]'")
    assert run("1,234.5 Kg.", "quantity") == ("ready", "+1234.5 Q11570", None)
    assert run("1.234,5", "quantity", decimal_comma=True) == ("ready", "+1234.5", None)
    assert run("about two", "quantity")[2] == "unclear number"
    assert run("[https://web.archive.org/web/2015/http://x.org/a site]", "url") == ("ready", "http://x.org/a", None)
    assert run("https://archive.is/x", "url", archive_urls="skip") == ("skipped", None, "a link to an archived copy")
    assert run("[[File:foo_bar.jpg|x]]", "commonsMedia") == ("ready", "Foo bar.jpg", None)
    assert run("Local.png", "commonsMedia")[2] == "the file is only on enwiki, not on Commons"
    assert run("{{coord|48|30|N|2|15|E|type:city}}", "globe-coordinate") == ("ready", "48.50, 2.25", None)
    assert run("nowhere", "globe-coordinate")[2] == "could not find a coordinate"


def test_spec_round_trip():
    spec = from_query("siteid=de&project=wikipedia&p=227&template=Normdaten&parameters=GND|%20x&limityear=1582-10-15&rel=l&qualifier=P580|param|a,%20b&also=P21|sex,gender&alreadyset=0&unknown=1&addprefix=%20x")
    assert (spec.property, spec.parameters, spec.date_limit, spec.limit_before, spec.add_prefix) == ("P227", ("GND", "x"), (1582, 10, 15), True, " x")
    assert spec.qualifiers == (("P580", "param", "a,b"),) and not spec.skip_any_value
    assert from_query(to_query(spec)) == spec
    odd = JobSpec(property="P1", template="A b", parameters=("1",), date_parameters=("y", None, "d"), coordinate_parameters=("a", "b"), manual_list=("x", "y"), constraints=(), date_limit=None, saved_query=7, julian=True, unit="Q5", decimal_comma=True, case="upper", instance_of=("Q5", "Q6"), use_page_title=True)
    assert from_query(to_query(odd)) == odd
    assert from_dict(json.loads(json.dumps(as_dict(odd)))) == odd
    assert for_extra(spec, 0).parameters == ("sex", "gender") and for_extra(spec, 0).template == "Normdaten"


@pytest.mark.parametrize("change", [{"template": ""}, {"parameters": ()}, {"property": None}, {"search": r"(a)\1"}, {"date_parameters": ("y", None, None)}])
def test_validation(change):
    good = {"property": "P1", "template": "X", "parameters": ("1",)}
    validate(JobSpec(**good), "string")
    with pytest.raises(InvalidSpec):
        validate(JobSpec(**good | change), "string")


def test_qualifiers_and_extra_properties(spark, catalog):
    spec = JobSpec(property="P1", template="Box", parameters=("v",), qualifiers=(("P580", "param", "from,since"), ("P642", "fixed", "Q5"), ("P580", "param", "also")), extra_properties=(("P2", ("w",)),), date_limit=None)
    kinds = {"P1": "string", "P580": "time", "P642": "wikibase-item", "P2": "external-id"}
    texts = ["{{Box|v=a|since=1999|w=5}}", "{{Box|v=b|also=3 May 2001|from=2000}}", "{{Box|v=c|from=circa 1950}}", "{{Box|w=7}}"]
    pages = spark.createDataFrame([(i, f"T {i}", "Q2") for i in range(len(texts))], "page_id bigint, title string, item string")
    revisions = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "page_id bigint, revision_id bigint, text string")
    rows = {(r["page_id"], r["field"]): r for r in evaluate_all(pages, revisions, spec, kinds, catalog).collect()}
    assert [rows[i, 0]["value"] for i in range(4)] == ["a; P580: 1999; P642: Q5", "b; P580: 2000; P642: Q5; P580: 2001-05-03", None, None]
    assert [rows[i, 0]["message"] for i in range(4)] == [None, None, "qualifier P580: imprecise date", "no value"]
    assert [rows[i, 1]["value"] for i in range(4)] == ["5", None, None, "7"]
    statement = json.loads(rows[1, 0]["statement"])
    assert statement["qualifiers-order"] == ["P580", "P642"] and [len(v) for v in statement["qualifiers"].values()] == [2, 1]
    assert statement["qualifiers"]["P580"][1]["datavalue"]["value"]["time"] == "+2001-05-03T00:00:00Z"


def test_python_runs_once_whatever_the_rules(spark, catalog):
    """Rules read checkpointed rows: the plan of outcomes has no Python part and reads no texts."""
    pages = spark.createDataFrame([(1, "T", "Q2"), (1, "T", "Q2"), (2, "U", "Q3")], "page_id bigint, title string, item string")
    revisions = spark.createDataFrame([(1, 10, "{{Box|v=a}}"), (2, 20, "{{Box|v=b}}")], "page_id bigint, revision_id bigint, text string")
    spec = JobSpec(property="P1", template="Box", parameters=("v",))
    rules = [C.Definition(k, "mandatory", {"P1793": ["[ab]"], "P2305": ["Q7"], "P2306": ["P9"]}) for k in ("Q21502404", "Q19474404", "Q21502410", "Q21503247", "Q52060874")]
    for n in (0, 1, 5):
        out = evaluate(pages, revisions, spec, "string", catalog, rules[:n])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and not re.search(r"[\[( ,]text#", plan)
        assert out.count() == 3  # a page that is listed twice gives two rows, not four
    assert {(r["item"], r["message"]) for r in out.collect()} == {("Q2", "constraint violation: item requires statement"), ("Q3", None)}


def test_prepare(spark):
    from tessera.plans import properties
    from tessera.sources.fixtures import view

    props = properties.properties(view(spark, "/root/testdata/sf0.001", "fx_property"))
    redirects = spark.createDataFrame([("IMDb_name", "IMDb"), ("iMDb title", "IMDb"), ("Other", "Else")], "from_title string, to_title string")
    templates = spark.createDataFrame([("IMDb",), ("Else",)], "title string")
    names = spark.createDataFrame([("Q1", "en", "gram"), ("Q2", "en", "gram"), ("Q1", None, "g"), ("Q9", "en", "metre")], "item string, language string, text string")
    base = JobSpec(property="P1", template="iMDb", parameters=("1",))
    made = properties.prepare(base, props, redirects, names, templates)
    assert (made.host, made.names, made.property.formatter_url) == ("en.wikipedia.org", ("iMDb", "IMDb name", "IMDb title"), "https://x.org/africa/$1")
    assert [d.kind for d in made.rules] == ["Q21502404", "Q21510860"]
    change = lambda **c: properties.prepare(JobSpec(**(as_dict(base) | c)), props, redirects, names, templates)
    assert [d.kind for d in change(constraints=()).rules] == ["Q21502404"]
    assert change(template_redirects=("IMDb title",)).names == ("iMDb", "IMDb title")
    amount = change(property="P2", unit="Q1", extra_properties=(("P3", ("x",)),))
    assert {(r["name"], r["unit"]) for r in amount.units.collect()} == {("gram", "Q1"), ("g", "Q1")} and amount.extras[0].property.id == "P3"
    wrong = {
        "P77 does not exist": {"property": "P77"}, "geo-shape is not supported": {"property": "P4"}, "the property is deprecated": {"property": "P5"}, "Template:No does not exist": {"template": "No"}, "unknown project": {"project": "x"},
        "language code": {"siteid": "E N"}, "P4: datatype": {"extra_properties": (("P4", ("x",)),)}, "qualifier P88 does not exist": {"qualifiers": (("P88", "param", "a"),)}, "qualifier P5": {"qualifiers": (("P5", "param", "a"),)},
        "qualifier P3: 'x'": {"qualifiers": (("P3", "fixed", "x"),)}, "no parameter": {"qualifiers": (("P3", "param", " , "),)},
    }
    for says, c in wrong.items():
        with pytest.raises(ValueError, match=says):
            change(**c)


def test_coordinates_titles_and_shown_values(spark, catalog):
    one = lambda text, datatype, **o: outcomes(spark, catalog, [("Q2", text)], JobSpec(property="P1", template="Box", **({"parameters": ("v",)} | o)), datatype)[0][0]
    assert one("{{Box|v=|52|31|N|13|24|E}}", "globe-coordinate", parameters=("v", "1")) == ("ready", "52.52, 13.40", None)
    assert one("{{Box|v=a}}", "monolingualtext", language="de") == ("ready", "a (de)", None)
    assert one("{{Box|v=4 May 1700}}", "time", julian=True, date_limit=None) == ("ready", "1700-05-04 (Julian)", None)
    gone = [("Q2", "{{Box|v=tt0000009}}")]
    assert outcomes(spark, catalog, gone, JobSpec(property="P9", template="Box", parameters=("v",), skip_any_value=False), "string")[0][0][2] == "this value was removed from the item before"


def test_existing_dates_by_their_precision(spark, catalog):
    from dataclasses import replace
    from pyspark.sql import functions as F

    known = catalog.claims.where("item = 'Q1'").withColumn("precision", F.lit(9))
    spec = JobSpec(property="P9", template="Box", parameters=("v",), skip_any_value=False)
    fine = outcomes(spark, replace(catalog, claims=known), [("Q1", "{{Box|v=2 January 1950}}"), ("Q1", "{{Box|v=1950}}")], spec, "time")[0]
    assert [x[2] for x in fine] == [None, "the item already has this value"]
    old = catalog.claims.where("item = 'Q1'").withColumn("rank", F.lit("deprecated"))
    assert outcomes(spark, replace(catalog, claims=old), [("Q1", "{{Box|v=1950}}")], spec, "time")[0][0][0] == "ready"
