"""What a run leaves: counts, pages of rows, merges, shares, logs."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tags as tag_list

STATUSES = ("pending", "ready", "done", "skipped", "error")
LOG_COLUMNS = ("page_id", "title", "item", "status", "raw_value", "value", "message")


def counts(rows: DataFrame) -> DataFrame:
    """Rows per run and status; a status that isn't known counts as an error; with total and percent complete."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("error")
    out = rows.groupBy("run_id").agg(*(F.count_if(known == s).alias(s) for s in STATUSES), F.count("*").alias("total"))
    finished = F.col("done") + F.col("skipped") + F.col("error")
    return out.withColumn("percent", F.when(F.col("total") > 0, F.round(100 * finished / F.col("total"), 0)).otherwise(0.0).cast("int"))


def page_of(rows: DataFrame, run_id: int, status: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    wanted = rows.where(F.col("run_id") == run_id)
    return (wanted if status is None else wanted.where(F.col("status") == status)).orderBy("seq").offset(offset).limit(min(limit, 500))


def next_rows(rows: DataFrame, run_id: int, statuses: list[str], after: int, limit: int = 50) -> DataFrame:
    return rows.where((F.col("run_id") == run_id) & F.col("status").isin(*statuses) & (F.col("seq") > after)).orderBy("seq").limit(limit)


def merged(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """rows with the updates of the same (run_id, seq); an update without an item keeps the row's."""
    new = updates.select("run_id", "seq", *(F.col(c).alias(f"_{c}") for c in ("item", "status", "value")), F.lit(True).alias("_hit"))
    out = rows.join(new, ["run_id", "seq"], "left")
    pick = {"item": F.coalesce("_item", "item"), "status": F.when(F.col("_hit"), F.col("_status")).otherwise(F.col("status")), "value": F.when(F.col("_hit"), F.col("_value")).otherwise(F.col("value"))}
    return out.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in rows.columns))


def recovered(status: Column) -> Column:
    """A run's status after a restart."""
    return F.when(status == "loading", "failed").when(status.isin("previewing", "editing"), "paused").otherwise(status)


def without_repeats(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row's before."""
    last = F.lag(value).over(Window.partitionBy(partition).orderBy(order))
    return rows.withColumn("_last", last).where("_last IS NULL OR NOT (_last <=> " + value + ")").drop("_last")


def failure_streaks(rows: DataFrame, partition: str = "run_id", order: str = "seq") -> DataFrame:
    """Longest run of errors in a row, per partition."""
    w = Window.partitionBy(partition).orderBy(order)
    marked = rows.withColumn("_island", F.sum((F.col("status") != "error").cast("int")).over(w))
    streaks = marked.where("status = 'error'").groupBy(partition, "_island").agg(F.count("*").alias("_n"))
    return streaks.groupBy(partition).agg(F.max("_n").alias("longest"))


# runs

#: States of a run; those in which it works, those that start it, those that end it.
RUN_STATES = ("loading", "ready", "previewing", "editing", "paused", "done", "failed")
ACTIVE, STARTS, ENDS = ("loading", "previewing", "editing"), ("previewing", "editing"), ("done", "failed")
#: From each state, where a run may go.
MOVES = {"loading": ("ready", "failed"), "ready": STARTS, "previewing": ("ready", "paused", "failed"), "editing": ("done", "paused", "failed"), "paused": STARTS, "done": STARTS, "failed": ("loading",)}


def new_run(spark: SparkSession, run_id: int, user_id: int, user_name: str, spec_json: str, created: int, share_id: int | None = None) -> DataFrame:
    """The row of a run that begins to load, with a random group for its edits."""
    row = (run_id, user_id, user_name, share_id, spec_json, "loading", secrets.token_hex(6), None, created, None, None)
    return spark.createDataFrame([row], "id bigint, user_id bigint, user_name string, share_id bigint, spec string, status string, editgroup string, message string, created bigint, started bigint, finished bigint")


def runs_changed(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs with the changes (id, status, message, at): started is set once, finished set at an end and cleared otherwise. Moves that aren't allowed change nothing."""
    new = changes.select(F.col("id").alias("_id"), F.col("status").alias("_to"), F.col("message").alias("_says"), F.col("at").alias("_at"))
    table = F.create_map(*(x for s, to in MOVES.items() for x in (F.lit(s), F.array(*map(F.lit, to)))))
    out = runs.join(new, runs["id"] == new["_id"], "left")
    moved = F.coalesce(F.array_contains(F.try_element_at(table, F.col("status")), F.col("_to")), F.lit(False))
    pick = {
        "status": F.when(moved, F.col("_to")).otherwise(F.col("status")), "message": F.when(moved, F.col("_says")).otherwise(F.col("message")),
        "started": F.when(moved & F.col("_to").isin(*STARTS), F.coalesce("started", "_at")).otherwise(F.col("started")),
        "finished": F.when(moved, F.when(F.col("_to").isin(*ENDS), F.col("_at"))).otherwise(F.col("finished")),
    }
    return out.select(*(pick[c].alias(c) if c in pick else F.col(c) for c in runs.columns))


def add_rows(rows: DataFrame, path: str) -> None:
    """Append numbered candidates as pending rows, a folder per run."""
    rows.select("run_id", "seq", "page_id", "title", "item", "field", F.lit("pending").alias("status")).write.mode("append").partitionBy("run_id").parquet(path)


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows, and the counts of their statuses (and `total`), which are known once the rows have been written or collected: they are taken on the way, without a second pass over them."""
    seen = Observation(name)
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("error")
    return rows.observe(seen, F.count(F.lit(1)).alias("total"), *(F.count_if(known == s).alias(s) for s in STATUSES)), seen


def latest_runs(runs: DataFrame, user_id: int | None = None, limit: int = 100) -> DataFrame:
    """The newest runs, of one user or of all."""
    return (runs if user_id is None else runs.where(F.col("user_id") == user_id)).orderBy(F.desc("id")).limit(limit)


def status_counts(rows: DataFrame, phase: Column) -> DataFrame:
    """Rows per phase and status, both from closed lists; what isn't known counts as other."""
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("other")
    return rows.groupBy(phase.alias("phase"), known.alias("status")).agg(F.count("*").alias("n"))


# shares


def owned_by(user_id: Column, user_name: Column, asker: int, asker_name: str) -> Column:
    """Does a share belong to the user? Those that were imported have no user id, only a name."""
    return F.when(user_id == 0, user_name == asker_name).otherwise(user_id == asker)


def share_title(template: Column, prop: Column, siteid: Column, project: Column) -> Column:
    return F.concat(template, F.lit(" → "), F.coalesce(prop, F.lit("")), F.lit(" ("), siteid, F.lit("."), project, F.lit(")"))


def share_row(spec: Column) -> Column:
    """struct(wiki, property, template, parameters) of a share's specification as JSON: date or coordinate parameters, the pattern, the page title, else the list."""
    s = F.from_json(spec, "siteid string, project string, property string, template string, parameters array<string>, date_parameters array<string>, coordinate_parameters array<string>, value_pattern string, use_page_title boolean")
    joined = lambda x: F.nullif(F.array_join(F.filter(x, lambda v: v.isNotNull() & (v != "")), ", "), F.lit(""))
    shown = F.coalesce(F.when(s["use_page_title"], "page title"), joined(s["date_parameters"]), joined(s["coordinate_parameters"]), F.nullif(s["value_pattern"], F.lit("")), joined(s["parameters"]), F.lit(""))
    return F.struct(F.concat(s["siteid"], F.lit("."), s["project"]).alias("wiki"), s["property"].alias("property"), s["template"].alias("template"), shown.alias("parameters"))


def shares_with_tags(shares: DataFrame, tags: DataFrame) -> DataFrame:
    """Every share with its tags in order, newest first."""
    lists = tags.groupBy(F.col("share_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return shares.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).orderBy(F.desc("id"))


def new_share(shares: DataFrame, share_id: int, user_id: int, user_name: str, title: str, spec_json: str, created: int) -> DataFrame:
    """shares with a new one; ValueError if there is one of the id."""
    if not shares.where(F.col("id") == share_id).isEmpty():
        raise ValueError(f"there is a share {share_id}")
    row = {"id": share_id, "user_id": user_id, "user_name": user_name, "title": title, "spec": spec_json, "created": created}
    return shares.unionByName(shares.sparkSession.range(1).select(*((F.lit(row.get(f.name)).cast(f.dataType)).alias(f.name) for f in shares.schema)))


def without_shares(shares: DataFrame, tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """shares and their tags without those of gone (id)."""
    return shares.join(gone, "id", "left_anti"), tags.join(gone.select(F.col("id").alias("share_id")), "share_id", "left_anti")


def retagged(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags (share_id, tag) with the lists of new (share_id, tags) in the place of what these shares had."""
    kept = tags.join(new.select("share_id"), "share_id", "left_anti").select("share_id", "tag")
    return kept.union(new.select("share_id", F.explode(tag_list(F.col("tags"))).alias("tag")))


def recorded(shares: DataFrame, runs: DataFrame) -> DataFrame:
    """shares with last_run_id, last_completed, last_done and last_errors of their latest complete run. runs: share_id, run_id, finished, done, error."""
    last = runs.where("finished IS NOT NULL").groupBy(F.col("share_id").alias("_share")).agg(F.max_by(F.struct("run_id", "finished", "done", "error"), F.struct("finished", "run_id")).alias("r"))
    named = {"last_run_id": "r.run_id", "last_completed": "r.finished", "last_done": "r.done", "last_errors": "r.error"}
    out = shares.join(last, F.col("id") == F.col("_share"), "left")
    return out.select(*(c for c in shares.columns if c not in named), *(F.coalesce(F.col(v), F.col(c)).alias(c) if c in shares.columns else F.col(v).alias(c) for c, v in named.items()))


def imported(listed: DataFrame, shares: DataFrame) -> DataFrame:
    """Old shares (legacy_id, user_name, template, property, siteid, project) with their title and outcome: imported, already there, or unusable (no property or template)."""
    there = shares.where("legacy_id IS NOT NULL").select("legacy_id", F.lit(True).alias("_there")).distinct()
    usable = F.col("property").isNotNull() & (F.trim(F.coalesce("template", F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy("legacy_id").orderBy("user_name"))
    out = listed.withColumn("_nth", nth).join(there, "legacy_id", "left")
    outcome = F.when(~usable, "unusable").when(F.col("_there") | (F.col("_nth") > 1), "already there").otherwise("imported")
    return out.select(*listed.columns, F.when(usable, share_title(F.col("template"), F.col("property"), F.col("siteid"), F.col("project"))).alias("title"), outcome.alias("outcome"))


def import_report(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("listed"), *(F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("imported", "already there", "unusable")))


def search(shares: DataFrame, text: str, columns: list[str], tag: str | None = None) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    out = shares.where(hit)
    return out if tag is None else out.where(F.array_contains("tags", tag))


def natural_key(text: Column) -> Column:
    """Sorts numbers in texts by size: a group of digits is its length without leading zeros, then itself."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))).otherwise(p)), "")


def write_log(rows: DataFrame, path: str) -> None:
    """CSV log of a run, ordered by seq, as one file; nulls are empty fields. (A run's log is what a person downloads: its size is bound by the limit of candidates.)"""
    rows.orderBy("seq").select(*LOG_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
