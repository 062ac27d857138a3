"""Status changes over a file stream."""

from pyspark.sql import functions as F

from tessera.streaming import run_status


def test_latest_status_over_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    changes = events.select(F.col("user_id").alias("run_id"), (F.col("event_id") % 50).alias("seq"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    changes.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = run_status.follow(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    last = query.lastProgress["batchId"] if query.lastProgress["numInputRows"] else query.lastProgress["batchId"] - 1
    got = {tuple(r) for r in run_status.read(spark, f"{tmp_path}/table", last).collect()}
    assert got == {tuple(r) for r in run_status.latest(changes).collect()}
    # superseded buckets are removed, those of the last two lists stay
    named = {(b, v) for n in (last, last - 1) for b, v in run_status._versions(spark, f"{tmp_path}/table", n).items()}
    assert {(int(p.name[7:]), int(p.parent.name[6:])) for p in tmp_path.glob("table/batch=*/bucket=*")} >= named


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    for i, run in enumerate((1, 2, 1)):
        spark.createDataFrame([(run, 5, f"s{i}", f"2024-01-0{i + 1} 00:00:00")], "run_id bigint, seq bigint, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(run_status.SCHEMA).parquet(f"{tmp_path}/in")
        run_status.follow(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert [len(list(tmp_path.glob(f"table/batch={n}/bucket=*"))) for n in (1, 2)] == [1, 1]
    assert sorted((r["run_id"], r["status"]) for r in run_status.read(spark, f"{tmp_path}/table", 2).collect()) == [(1, "s2"), (2, "s1")]


def test_the_number_of_buckets_stays_with_the_table(spark, tmp_path):
    for i, buckets in enumerate((5, 64)):
        spark.createDataFrame([(r, 1, f"s{i}", f"2024-01-0{i + 1} 00:00:00") for r in range(40)], "run_id bigint, seq bigint, status string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_status.follow(spark.readStream.schema(run_status.SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/table", f"{tmp_path}/checkpoint", buckets).awaitTermination(120)
    rows = run_status.read(spark, f"{tmp_path}/table", 1).collect()
    assert len(rows) == 40 and {r["status"] for r in rows} == {"s1"} and len(run_status._versions(spark, f"{tmp_path}/table", 1)) <= 5


def test_windows(spark):
    rows = spark.createDataFrame([("ready", "2024-01-01 00:10:00"), ("ready", "2024-01-01 00:50:00"), ("done", "2024-01-01 01:10:00")], "status string, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted((str(r["start"])[11:13], r["status"], r["n"]) for r in run_status.counts_per_window(rows).collect()) == [("00", "ready", 2), ("01", "done", 1)]
