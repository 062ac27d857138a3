"""Run-row status changes as a stream: the latest status per row, kept in a table, one merge per batch.

Events: run_id, seq, status, at. Each micro-batch is reduced to the latest change per row before it meets the table, so a row that
changes often costs one row. The table is cut into buckets by run; a batch reads and writes only the buckets that it touches, under its own number, and
then the list of which batch has each bucket. A batch that is repeated after a failure starts from the list before it and gives the same
table. Buckets that neither of the last two lists names are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Buckets of a new table; the number is kept with the table and holds for all batches after the first.
BUCKETS = 64
SCHEMA = "run_id bigint, seq bigint, status string, at timestamp"


def latest(events: DataFrame) -> DataFrame:
    """The last change per (run_id, seq); of equal times the greatest status."""
    return events.groupBy("run_id", "seq").agg(F.max(F.struct("at", "status")).alias("m")).select("run_id", "seq", "m.status", "m.at")


def merged(table: DataFrame, changes: DataFrame) -> DataFrame:
    return latest(table.unionByName(latest(changes)))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch has each bucket, after a batch; a row per bucket."""
    if number < 0:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").json(f"{path}/_versions/{number}").collect()}


def _buckets(spark: SparkSession, path: str, wanted: int) -> int:
    """How many buckets the table has; a new table gets the wanted number, which is written down first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_buckets")
    return spark.read.schema("buckets int").json(f"{path}/_buckets").first()["buckets"]


def _rows(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    places = [f"{path}/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(SCHEMA).parquet(*places) if places else spark.createDataFrame([], SCHEMA)


def follow(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the table under `path` up to date until no event is left (availableNow). buckets: of a new table; choose so many that a bucket stays at some hundred megabytes."""
    buckets = _buckets(events.sparkSession, path, buckets)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _versions(spark, path, number - 1)
        changes = latest(batch.select(F.col("run_id").cast("bigint").alias("run_id"), F.col("seq").cast("bigint").alias("seq"), "status", F.col("at").cast("timestamp").alias("at"))).persist()
        try:
            touched = [r["b"] for r in changes.select(_bucket(buckets).alias("b")).distinct().collect()]
            out = latest(_rows(spark, path, {b: old[b] for b in touched if b in old}).unionByName(changes))
            out.withColumn("bucket", _bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        finally:
            changes.unpersist()
        new = old | {b: number for b in touched}
        spark.createDataFrame(sorted(new.items()), "bucket int, version bigint").coalesce(1).write.mode("overwrite").json(f"{path}/_versions/{number}")
        _remove(spark, path, set(_versions(spark, path, number - 2).items()) - set(old.items()) - set(new.items()))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _remove(spark: SparkSession, path: str, gone: set[tuple[int, int]]) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for bucket, version in gone:
        place = hadoop(f"{path}/batch={version}/bucket={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The table as it is after a batch (one of the last two); None before the first."""
    return None if number < 0 else _rows(spark, path, _versions(spark, path, number))


def counts_per_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes per window and status; events later than the watermark are left out of closed windows."""
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
