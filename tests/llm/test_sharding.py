"""Shards against plain prefix sums, with nulls, ties, repeated rows, a hot id, long and empty texts."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, size int, _at int"
ROWS = [(i, "wörd " * (i * 7 % 23), "x", 1, 1) for i in range(200)] + [(7, "same", "x", 1, 1)] * 90 + [(None, None, "y", 1, 1), (None, None, "y", 1, 1), (None, "", "y", 1, 1), (2**53 + 1, "long " * 40_000, "y", 1, 1), (-5, "", None, None, None)]


def sizes(rows):
    return [len((r[1] or "").encode()) + 16 for r in rows]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_equal_contiguous_gapless(spark, shards):
    got = sharding.assign(spark.createDataFrame(ROWS, SCHEMA).repartition(5), shards).collect()
    assert len(got) == len(ROWS)
    key = lambda i: (i is None, i or 0)
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((key(r[0]), s, zlib.crc32((r[1] or "").encode())) for r, s in zip(ROWS, sizes(ROWS), strict=True))
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [key(r["doc_id"]) for r in got] == sorted(key(r[0]) for r in ROWS)  # contiguous in the order
    total, at = sum(sizes(ROWS)), 0
    for r in got:  # the middle of each row decides
        assert r["shard"] == min(shards - 1, (2 * at + r["size"]) * shards // (2 * total))
        at += r["size"]
    for k in {r["shard"] for r in got}:
        assert [r["slot"] for r in got if r["shard"] == k] == list(range(sum(r["shard"] == k for r in got)))


def test_same_whatever_the_ranges(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 17), "", 0, 0) for i in range(300)], SCHEMA)
    a, b = (sorted(map(tuple, sharding.assign(docs.repartition(n), 9, ranges=m).collect())) for n, m in ((1, 1), (6, 13)))
    assert a == b


def test_equal_texts_are_neighbours(spark):
    docs = spark.createDataFrame([(i, f"text {i % 10}", "", 0, 0) for i in range(500)], SCHEMA)
    got = sorted((r["shard"], r["slot"], r["text_key"]) for r in sharding.assign(docs, 5, order=["text_key", "doc_id"]).collect())
    keys = [k for *_, k in got]
    assert sum(a != b for a, b in zip(keys, keys[1:])) == 9


def test_rows_with_their_places_and_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = sharding.sharded(docs, 6)
    assert sorted(out.columns) == sorted({*docs.columns, "slot"})
    places = sorted((r["shard"], r["slot"]) for r in out.collect())
    assert places == sorted((r["shard"], r["slot"]) for r in sharding.assign(docs, 6).collect())
    assert len(set(places)) == len(ROWS)
    sharding.write_shards(docs, str(tmp_path / "s"), 6)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ROWS) and sorted((r["shard"], r["slot"]) for r in back.collect()) == places


def test_empty_and_fewer_rows_than_shards(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.assign(none).count() == sharding.sharded(none).count() == 0
    few = sharding.assign(spark.createDataFrame(ROWS[:3], SCHEMA), 40).collect()
    assert len({r["shard"] for r in few}) == 3 and {r["slot"] for r in few} == {0}
    with pytest.raises(ValueError):
        sharding.assign(none, 0)


def test_no_python_in_the_plan(spark):
    plan = sharding.sharded(spark.createDataFrame(ROWS, SCHEMA).where(F.col("doc_id") < 9)).explain
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as said:
        plan()
    assert "Python" not in said.getvalue() and "Arrow" not in said.getvalue()
