"""Runs, logs, lookups and limits in small worlds."""

import csv
import glob

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import constraints as C
from tessera.operators.closure import LimitExceeded
from tessera.plans import candidates, results
from tessera.sources import lookups


def test_new_run_and_log(spark, tmp_path):
    run = results.new_run(spark, 7, 3, "Ann", "{}", 1_700_000_000).first()
    assert (run["status"], run["started"], len(run["editgroup"])) == ("loading", None, 12) and int(run["editgroup"], 16) >= 0
    rows = spark.createDataFrame([(2, 11, "B, \"b\"", None, "ready", "raw", None, None), (1, 10, "A", "Q1", "done", "r", "v", "m")], "seq int, page_id int, title string, item string, status string, raw_value string, value string, message string")
    results.write_log(rows, f"{tmp_path}/log")
    files = glob.glob(f"{tmp_path}/log/*.csv")
    assert len(files) == 1
    with open(files[0], newline="") as f:
        assert list(csv.reader(f)) == [list(results.LOG_COLUMNS), ["10", "A", "Q1", "done", "r", "v", "m"], ["11", 'B, "b"', "", "ready", "raw", "", ""]]


def test_tags_keys_and_hosts(spark):
    row = spark.range(1).select(
        T.tags(F.array(F.lit(" Czech  Wikipedia "), F.lit("films"), F.lit("films"), F.lit(""))).alias("tags"), F.transform(F.array(F.lit("a-b1"), F.lit("日本"), F.lit("<x>"), F.lit("x" * 33)), T.tag_ok).alias("ok"),
        T.full_title(F.lit("Template"), F.lit("A_b")).alias("full"), T.full_title(F.lit(""), F.lit("A_b")).alias("bare"), T.db_key(F.lit("vorlage : box_a b"), ("Template", "Vorlage")).alias("key"), T.db_key(F.lit("box"), first_letter=False).alias("low"),
    ).first()
    assert (row["tags"], row["ok"], row["full"], row["bare"], row["key"], row["low"]) == (["czech-wikipedia", "films"], [True, True, False, False], "Template:A b", "A b", "Box_a_b", "box")
    assert lookups.host_for("zh-min-nan", "wiktionary") == "zh-min-nan.wiktionary.org" and lookups.host_for("x y", "commons") == "commons.wikimedia.org"
    for bad in (("en", "evil"), ("en.evil/", "wikipedia")):
        with pytest.raises(ValueError):
            lookups.host_for(*bad)


def test_limits_saved_queries_and_editions(spark):
    pages = spark.range(5).selectExpr("id AS page_id", "CAST(id % 2 AS INT) AS namespace", "concat('Q_', id) AS title")
    assert candidates.limited(pages, 5) is pages
    with pytest.raises(LimitExceeded):
        candidates.limited(pages, 4)
    ours, none = lookups.saved_query(pages, "enwiki", "enwiki")
    assert none is None and sorted(r["page_id"] for r in ours.collect()) == [1, 2, 3, 4]
    none, items = lookups.saved_query(pages, "wikidatawiki", "enwiki")
    assert none is None and sorted(r["item"] for r in items.collect()) == ["Q 0", "Q 2", "Q 4"]
    with pytest.raises(ValueError, match="not on enwiki"):
        lookups.saved_query(pages, "dewiki", "enwiki")
    claims = spark.createDataFrame([("Q5", "P1800", "normal", "enwiki"), ("Q3", "P1800", "deprecated", "enwiki")], "item string, property string, rank string, text_value string")
    assert lookups.edition(claims, "enwiki") == "Q5" and lookups.edition(claims, "xx") is None
    with pytest.raises(ValueError):
        lookups.user_items(spark, "SELECT 1 AS x")
    assert lookups.template_redirects("A", claims.selectExpr("item AS from_title", "property AS to_title"), claims.selectExpr("'B' AS title")) is None


def test_patterns_of_another_dialect(spark):
    assert C.whole_match(F.col("x"), "(?P<a>x)(?P=a)") is not None and C.whole_match(F.col("x"), "(") is None
    rows = spark.createDataFrame([("tt1",), ("été",), (None,)], "v_text string")
    hit = lambda p: [r[0] for r in rows.select(C.format_(F.col("v_text"), p)).collect()]
    assert hit(r"\p{L}+") == [True, False, False] and hit("(") == [False] * 3 and hit("(?P<x>tt)1") == [False, True, False]


def test_from_a_specification_to_outcomes(spark):
    from tessera.plans import properties, run
    from tessera.plans.evaluate import Catalog
    from tessera.plans.job import JobSpec
    from tessera.sources.fixtures import view

    d = "/root/testdata/sf0.001"
    part = spark.read.parquet(f"{d}/part.parquet")
    wiki = run.Wiki(view(spark, d, "fx_linktarget"), view(spark, d, "fx_templatelinks"), view(spark, d, "fx_page"), view(spark, d, "fx_page_props"), view(spark, d, "fx_categorylinks"), view(spark, d, "fx_claims"), view(spark, d, "fx_subclass"), "enwiki")
    spec = JobSpec(property="P1", template="Brand#4", parameters=("id",), items_sql="SELECT concat('Q', id) AS item FROM range(0, 200) WHERE id % 3 > 0", skip_removed=False)
    marked = run.candidate_pages(spec, wiki)
    want = {r["p_partkey"] for r in part.where("p_brand = 'Brand#4' AND p_partkey % 5 > 0 AND p_partkey % 3 > 0").collect()}
    held = {r["item"] for r in wiki.claims.where("property = 'P1'").collect()}
    assert {r["page_id"] for r in marked.where("reason IS NULL").collect()} == {p for p in want if f"Q{p}" not in held} != set()
    assert run.excluded_json(marked).startswith('{"')
    props = properties.properties(view(spark, d, "fx_property"))
    prepared = properties.prepare(spec, props, spark.createDataFrame([], "from_title string, to_title string"))
    revisions = part.selectExpr("p_partkey AS page_id", "p_partkey AS revision_id", "concat('{{Brand#4|id=', IF(p_partkey % 2 = 0, 'tt', 'x'), p_partkey, '}}') AS text")
    kinds = "CAST(NULL AS STRING) AS unit", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude"
    claims = wiki.claims.selectExpr("item", "property", "rank", "item_value", "text_value", "amount", "year", "month", "day", *kinds)
    out = run.outcomes(prepared, marked, revisions, Catalog(claims)).collect()
    assert {(r["page_id"], r["message"]) for r in out} == {(p, None if p % 2 == 0 else "constraint violation: format") for p in want if f"Q{p}" not in held}
    pages, again = run.first_that_works([lambda: (_ for _ in ()).throw(OSError("no replica")), lambda: marked]), marked
    assert pages is again
    with pytest.raises(LimitExceeded):
        run.first_that_works([lambda: candidates.limited(part, 3), lambda: marked])
