"""The run store: batches that fail and come again, passes that go on where they stopped, both page sources, counts on the way."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import closure
from tessera.plans import pages, results, run
from tessera.plans.job import JobSpec
from tessera.plans.store import RunStore


def numbered(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("seq"), (F.col("id") / 2).cast("long").alias("page_id"), F.lit("T").alias("title"), F.concat(F.lit("Q"), "id").alias("item"), (F.col("id") % 2).cast("int").alias("field"))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    for _ in range(2):
        store.add_rows(1, numbered(spark, 40), 0, rows_per_file=7)
    store.add_rows(1, numbered(spark, 10, 40), 1)
    assert store.rows(1).count() == 50 and store.rows(2).count() == 0
    done = numbered(spark, 5).select("seq", F.lit("done").alias("status"), F.lit(None).cast("string").alias("item"), F.lit("v").alias("value"))
    for _ in range(2):
        store.add_outcomes(1, done, 0)
    store.add_outcomes(1, done.where("seq < 2").withColumn("status", F.lit("error")).withColumn("item", F.lit("Q9")), 1)
    got = {r["seq"]: (r["status"], r["item"], r["value"]) for r in store.rows(1).collect()}
    assert got[0] == ("error", "Q9", "v") and got[2] == ("done", "Q2", "v") and got[7] == ("pending", "Q7", None)
    assert sum(s == "pending" for s, *_ in got.values()) == 45


def test_a_batch_that_fails_half_way(spark, tmp_path):
    """The folder is written, the task dies before the commit: the batch runs again and leaves the same rows."""
    store, tries = RunStore(spark, str(tmp_path)), []
    store.add_rows(3, numbered(spark, 60), 0, rows_per_file=10)
    real = store._commit

    def breaks(run_id, kind, number, entry):
        tries.append((kind, number))
        if kind == "outcomes" and number == 1 and tries.count((kind, number)) == 1:
            raise OSError("lost")
        real(run_id, kind, number, entry)

    store._commit = breaks
    outcome = lambda rows: rows.select("seq", "item", F.lit("ready").alias("status"), F.col("title").alias("value"))
    with pytest.raises(Exception, match="lost"):
        store.follow(3, outcome, files_per_batch=2).awaitTermination(120)
    assert 0 < store.rows(3).where("status = 'ready'").count() < 60
    store.follow(3, outcome, files_per_batch=2).awaitTermination(120)
    rows = store.rows(3).collect()
    assert len(rows) == 60 and {r["status"] for r in rows} == {"ready"} and tries.count(("outcomes", 1)) == 2
    store.follow(3, outcome, files_per_batch=2).awaitTermination(120)  # nothing is left
    assert store.rows(3).count() == 60
    # another pass takes what is ready, and may change it
    edited = lambda r: r.select("seq", F.when(F.col("seq") % 2 == 0, "done").otherwise("error").alias("status"))
    store.follow(3, edited, statuses=("ready",), name="edit").awaitTermination(120)
    assert {r["status"]: r["count"] for r in store.rows(3).groupBy("status").count().collect()} == {"done": 30, "error": 30}
    assert {r["item"] for r in store.rows(3).where("seq = 5").collect()} == {"Q5"}
    with pytest.raises(ValueError):
        store.follow(9, outcome)


def test_pages_of_one_batch(spark, tmp_path):
    """The rows of a page, one per field, are in one file."""
    store = RunStore(spark, str(tmp_path))
    store.add_rows(1, numbered(spark, 64), 0, rows_per_file=5)
    rows = spark.read.parquet(*(e["folder"] for e in store._manifests(1, "rows").values())).withColumn("file", F.input_file_name()).collect()
    assert len({r["file"] for r in rows}) > 5 and len({(r["page_id"], r["file"]) for r in rows}) == 32


DUMP = [
    (1, 0, "Anna", None, 11, "{{Box|v=1}} [[Category:People]]"), (2, 0, "Bert & Co", None, 12, "{{box}} <!-- {{Other}} --> [[category: people |x]]"), (3, 0, "Cora", None, 13, "{{Kasten|a={{Other}}}}"), (4, 0, "Dora", None, 14, "no <b>template</b> \"x\""),
    (5, 10, "Template:Kasten", "Template:Box", 15, "#REDIRECT [[Template:Box]]"), (6, 10, "Template:Box", None, 16, ""), (7, 14, "Category:People", None, 17, "[[Category:All]]"), (8, 1, "Talk:Anna", None, 18, "{{Box}}"), (9, 0, "Emil", None, 19, "<ref>{{Box}}</ref>[[Category:All]]"),
]


@pytest.fixture(scope="module")
def wiki(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dump") / "d")
    pages.write_dump(spark.createDataFrame(DUMP, "page_id bigint, namespace int, title string, redirect string, revision_id bigint, text string").repartition(3), path)
    items = spark.createDataFrame([(1, "Q1"), (2, "Q2"), (3, "Q3")], "page_id bigint, item string")
    none = spark.createDataFrame([], "item string, property string, rank string, item_value string")
    return path, pages.tables_of_dump(spark, path, items, none, spark.createDataFrame([], "child string, parent string"), "xwiki")


def test_candidates_from_a_dump(spark, wiki):
    path, tables = wiki
    back = {r["page_id"]: r["text"] for r in pages.dump_revisions(spark, path).collect()}
    assert back == {d[0]: d[5] or None for d in DUMP}
    spec = JobSpec(property="P1", template="template:box", parameters=("v",), category="category:all", depth=1, skip_any_value=False)
    found = {r["page_id"]: r["reason"] for r in run.candidate_pages(spec, tables).collect()}
    assert found == {1: None, 2: None, 3: "not_in_category"}
    assert {r["page_id"] for r in pages.TableSource(tables).category_members("All", 0, None, None).collect()} == {9}


def test_a_dump_is_cut_by_byte_ranges(spark, tmp_path):
    """One file, far larger than a split, with pages of many lines: every page once, and several tasks."""
    rows = spark.range(3_000).select(F.col("id").alias("page_id"), (F.col("id") % 2).cast("int").alias("namespace"), F.concat(F.lit("T"), "id").alias("title"), F.lit(None).cast("string").alias("redirect"), "id", F.repeat(F.lit("a line\n"), (F.col("id") % 50).cast("int")).alias("text"))
    pages.write_dump(rows.withColumnRenamed("id", "revision_id").coalesce(1), str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        read = pages.dump_pages(spark, str(tmp_path / "d"))
        assert read.rdd.getNumPartitions() > 5
        assert sorted((r["page_id"], len(r["text"] or "")) for r in read.collect()) == [(i, 7 * (i % 50)) for i in range(3_000)]
        assert pages.dump_pages(spark, str(tmp_path / "d"), (1,)).count() == 1_500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fallback(spark, wiki):
    class Broken:
        def transclusions(self, template, namespace):
            return spark.range(1).select(F.raise_error(F.lit("no replica")).alias("page_id"))

        def category_members(self, *_):
            raise closure.LimitExceeded("more than 1 pages")

    both = pages.WithFallback((Broken(), pages.TableSource(wiki[1])))
    assert {r["page_id"] for r in both.transclusions("Box", 0).collect()} == {1, 2, 3}
    with pytest.raises(closure.LimitExceeded):
        both.category_members("All", 0, None, None)


def test_counts_on_the_way(spark, tmp_path):
    rows = spark.range(100).select(F.element_at(F.array(F.lit("ready"), F.lit("done"), F.lit("lost")), (F.col("id") % 3 + 1).cast("int")).alias("status"), "id")
    out, seen = results.observed(rows, "outcomes")
    out.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"total": 100, "ready": 34, "done": 33, "error": 33, "pending": 0, "skipped": 0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and plan.count("Range") == 1 and "Exchange" not in plan


def test_new_share(spark):
    shares = spark.createDataFrame([(1, "a", 5, "u", None)], "id bigint, title string, user_id bigint, user_name string, spec string")
    got = results.new_share(shares, 2, 7, "Ann", "B", "{}", 0)
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "a", 5, "u", None), (2, "B", 7, "Ann", "{}")]
    with pytest.raises(ValueError):
        results.new_share(shares, 1, 7, "Ann", "B", "{}", 0)
