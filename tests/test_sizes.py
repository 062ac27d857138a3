"""Queries over tables of other sizes than the driver's smallest ones, against DuckDB where they have SQL."""

import os

import pytest
from oracle import same
from pyspark.sql import functions as F

from tessera import queries, run_queries  # noqa: F401  (registers its queries with the others)
from tessera.operators.closure import LimitExceeded
from tessera.plans import evaluate, run
from tessera.plans.job import JobSpec

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """tables(name=rows): the smallest tables, some of them replaced."""

    def made(**own):
        for file in os.listdir(SMALL):
            name = file.removesuffix(".parquet")
            if name in own:
                own[name].write.parquet(f"{tmp_path}/{file}")
            else:
                os.symlink(f"{SMALL}/{file}", f"{tmp_path}/{file}")
        return str(tmp_path)

    return made


def test_chains_whose_keys_end_or_are_missing(spark, tables):
    """A table that ends inside a circle (8 of 11) or has gaps inside chains."""
    customer = spark.read.parquet(f"{SMALL}/customer.parquet").where("c_custkey < 20 AND c_custkey NOT IN (3, 9)")
    same(spark, tables(customer=customer), queries.QUERIES["merged_item_chains"], queries.ORACLE["merged_item_chains"])


def test_merged_items_of_over_a_million_parts(spark, tables):
    """Keys that are half a million and a million apart."""
    part = spark.read.parquet(f"{SMALL}/part.parquet").where("p_partkey < 12")
    far = part.selectExpr("*", "explode(array(0, 500000, 1000000, 1500000)) AS by").withColumn("p_partkey", F.expr("p_partkey + by")).drop("by")
    same(spark, tables(part=far), queries.QUERIES["evaluate_merged_items"], queries.ORACLE["evaluate_merged_items"])


def test_a_category_may_hold_more_pages_than_a_run(spark):
    """The limit is on the pages that use the template; what else is in their category doesn't count."""
    number = spark.range(100).withColumnRenamed("id", "page_id")
    page = number.selectExpr("page_id", "0 AS namespace", "concat('T', page_id) AS title", "page_id AS latest_revision")
    links = number.where("page_id < 5").selectExpr("page_id AS from_id", "0 AS from_namespace", "1 AS target_id")
    props = number.selectExpr("page_id", "'wikibase_item' AS name", "concat('Q', page_id) AS value")
    small = number.where("page_id > 1").selectExpr("'Small' AS parent", "concat('T', page_id) AS child", "'page' AS kind", "page_id")
    claims = spark.createDataFrame([], "item string, property string, rank string, item_value string")
    wiki = run.Wiki(spark.createDataFrame([(1, 10, "Box")], "lt_id int, namespace int, title string"), links, page, props, small, claims, claims.selectExpr("item AS child", "item AS parent"), "enwiki")
    marked = run.candidate_pages(JobSpec(property="P9", template="Box", parameters=("a",), category="Small"), wiki, most_pages=5)
    assert {r["page_id"]: r["reason"] for r in marked.collect()} == {0: "not_in_category", 1: "not_in_category", 2: None, 3: None, 4: None}
    with pytest.raises(LimitExceeded):
        run.candidate_pages(JobSpec(property="P9", template="Box", parameters=("a",), category="Small"), wiki, most_pages=4)


@pytest.mark.parametrize("name", ["pattern_replacements", "permalinks_and_specifications"])
def test_costly_work_on_few_bytes_is_every_cores(spark, name):
    """The table is one small file, which the scan leaves in one task."""
    assert queries.QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("kind", ["string", "quantity"])
def test_pages_are_read_by_every_core(spark, kind):
    pages, revisions = run_queries._world(spark, SMALL, "concat('{{Box|v=', p_size, '}}')")
    rows = evaluate.typed_rows(pages, revisions, [evaluate.Field(JobSpec(property="P9", template="Box", parameters=("v",)), kind)], evaluate.Catalog(queries._claims(spark, SMALL)))
    assert rows.rdd.getNumPartitions() >= 4 and rows.count() == pages.count() and rows.where("value IS NULL").isEmpty()
