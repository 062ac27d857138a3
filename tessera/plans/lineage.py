"""Reliable checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ready(spark: SparkSession) -> str:
    """The shared folder, set where it is unset in a local session."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_ready(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in spark.checkpoint.dir; where that is unset, a local session gets a folder of its own, a cluster is refused."""
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to several tasks a core. For work that costs far more than its rows' bytes: files and the results of joins are cut into tasks by bytes, so a few MB of them would all be one core's."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)
