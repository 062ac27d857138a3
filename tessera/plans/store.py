"""The store of a run: rows and outcomes in numbered batches, committed by a manifest, so that a batch that is written again counts once.

A batch is written to a folder of its own; only then the manifest of its number names that folder, in one small file. A writer that fails half-way leaves a folder that no manifest names; when the
batch runs again, it writes another one and the manifest names that. Readers see committed batches only, and never a folder that is being written.

    path/run=R/rows/...        candidates as pending rows       path/run=R/outcomes/...    what became of them
    path/run=R/_rows/N         manifest of batch N              path/run=R/_outcomes/N

`follow` is the loop over a run: the row batches are a stream of files, a few per micro-batch, in the order of seq; outcomes are committed under the micro-batch's number, so that a run
that was stopped goes on behind the last committed batch, and one that failed in a batch repeats it. The pages of a row are never in two batches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROWS = "seq bigint, page_id bigint, title string, item string, field int"
OUTCOMES = "seq bigint, item string, raw_value string, value string, status string, message string, statement string, at timestamp"


@dataclass
class RunStore:
    spark: SparkSession
    path: str

    # files

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _home(self, run_id: int) -> str:
        return f"{self.path.rstrip('/')}/run={run_id}"

    def _manifests(self, run_id: int, kind: str) -> dict[int, dict]:
        """What each committed batch is; as many small files as there are batches."""
        fs, place = self._fs(f"{self._home(run_id)}/_{kind}")
        if not fs.exists(place):
            return {}
        # (a name that begins with a dot is being written)
        names = [s.getPath() for s in fs.listStatus(place) if s.getPath().getName().isdigit()]
        return {int(p.getName()): json.loads(self._read(fs, p)) for p in names}

    def _read(self, fs, place) -> str:
        stream = fs.open(place)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, run_id: int, kind: str, number: int, entry: dict) -> None:
        """Write the manifest beside its place, then move it there, over an older one."""
        fs, place = self._fs(f"{self._home(run_id)}/_{kind}/{number}")
        _, draft = self._fs(f"{self._home(run_id)}/_{kind}/.{number}-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        fs.delete(place, False)
        if not fs.rename(draft, place):
            raise OSError(f"can't commit batch {number} of run {run_id}")

    def _write(self, run_id: int, kind: str, number: int, rows: DataFrame) -> None:
        folder = f"{self._home(run_id)}/{kind}/{number}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        self._commit(run_id, kind, number, {"folder": folder})

    def _committed(self, run_id: int, kind: str, schema: str) -> DataFrame:
        found = sorted(self._manifests(run_id, kind).items())
        if not found:
            return self.spark.createDataFrame([], schema + ", batch bigint")
        # the number of a batch is in its folder's name, so it needn't be in the rows
        rows = self.spark.read.schema(schema).parquet(*(e["folder"] for _, e in found))
        return rows.withColumn("batch", F.regexp_extract(F.input_file_name(), rf"/{kind}/([0-9]+)-[0-9a-f]+/", 1).cast("long"))

    # rows

    def add_rows(self, run_id: int, numbered: DataFrame, number: int = 0, rows_per_file: int = 5_000) -> None:
        """Commit a batch of numbered candidates (seq, page_id, title, item, field); one that is added again under its number replaces what was there. Files hold ranges of seq, and all rows of a page."""
        columns = [F.col(c.split()[0]).cast(c.split()[1]) for c in ROWS.split(", ")]
        rows = numbered.select(*columns)
        many = max(1, -(-rows.count() // rows_per_file))
        first = rows.groupBy("page_id").agg(F.min("seq").alias("_first"))
        out = rows.join(first, "page_id").repartitionByRange(many, "_first").sortWithinPartitions("seq").drop("_first")
        self._write(run_id, "rows", number, out)

    def rows(self, run_id: int) -> DataFrame:
        """The run's rows as they are now: status pending, or that of their latest outcome; an outcome without an item keeps the row's."""
        rows = self._committed(run_id, "rows", ROWS).drop("batch").dropDuplicates(["seq"])
        last = self._committed(run_id, "outcomes", OUTCOMES).groupBy("seq").agg(F.max_by(F.struct("item", "raw_value", "value", "status", "message", "statement"), F.struct("at", "batch")).alias("o"))
        out = rows.join(last, "seq", "left")
        return out.select(
            F.lit(run_id).cast("long").alias("run_id"), "seq", "page_id", "title", F.coalesce("o.item", "item").alias("item"), "field", F.coalesce("o.status", F.lit("pending")).alias("status"), "o.raw_value", "o.value", "o.message", "o.statement"
        )

    def add_outcomes(self, run_id: int, outcomes: DataFrame, number: int) -> None:
        """Commit a batch of outcomes (seq and what OUTCOMES names); columns that are missing are null, `at` is now."""
        columns = [(c.split()[0], c.split()[1]) for c in OUTCOMES.split(", ")]
        missing = lambda c, kind: F.current_timestamp() if c == "at" else F.lit(None).cast(kind)
        self._write(run_id, "outcomes", number, outcomes.select(*((F.col(c).cast(kind) if c in outcomes.columns else missing(c, kind)).alias(c) for c, kind in columns)))

    def last_batch(self, run_id: int) -> int:
        """The greatest number of a committed batch of outcomes; -1 before the first."""
        return max(self._manifests(run_id, "outcomes"), default=-1)

    # the loop

    def follow(self, run_id: int, outcome_of: Callable[[DataFrame], DataFrame], statuses: tuple[str, ...] = ("pending",), files_per_batch: int = 8, name: str = "preview") -> StreamingQuery:
        """Put all committed rows of the run through outcome_of(rows) -> outcomes (seq, status, ...), some files at a time, until none is left.

        statuses: which rows are taken, by their status when their batch begins. name: of the pass over the run (a preview, an edit); each pass has its own place in the run, so what a pass
        has done is not done again by it.
        """
        folders = [e["folder"] for _, e in sorted(self._manifests(run_id, "rows").items())]
        if not folders:
            raise ValueError(f"run {run_id} has no rows")
        base = self.last_batch(run_id) + 1
        home, pass_file = self._home(run_id), f"passes/{name}"
        begun = self._manifests(run_id, pass_file).get(0)
        if begun is None:  # outcomes of a pass are numbered from where it began
            begun = {"base": base}
            self._commit(run_id, pass_file, 0, begun)

        def write(batch: DataFrame, number: int) -> None:
            now = self.rows(run_id).select("seq", "status", F.col("item").alias("_item"))
            due = batch.join(now, "seq").where(F.col("status").isin(*statuses)).withColumn("item", F.col("_item")).drop("_item", "status")
            self.add_outcomes(run_id, outcome_of(due), begun["base"] + number)

        stream = self.spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_batch).parquet("{" + ",".join(folders) + "}" if len(folders) > 1 else folders[0])
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/_checkpoints/{name}").trigger(availableNow=True).start()
