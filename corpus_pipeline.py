"""The corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and reads
it again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard, mixing, packing, quality_crf
from tessera.llm.common import remove, scratch, table
from tessera.llm.queries import word_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on the labelled ones, doesn't score as bad."""
    return quality_crf.keep_good(docs, quality_crf.fit(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more (five-word shingles), the row with the smallest doc_id; SimHash anchors first, the rest exactly."""
    return jaccard.drop_alike(docs, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources up to 1.5 times as often as the largest."""
    # documents may have columns of the names that the operator adds: theirs come back
    own = {c: f"_own_{c}" for c in docs.columns if c in mixing.ADDED}
    drawn = mixing.mixed(docs.withColumnsRenamed(own), repeat_limit=1.5)
    return drawn.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids, numbered as sequences."""
    # workers serve all stages in turn, so the tokenizer's cache is smaller here
    return packing.pack(docs, word_tokenizer(), with_ids=True, keep=120_000)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Tokenizer, fingerprints and classifier are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:  # nothing reads the stage before this one any more
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
