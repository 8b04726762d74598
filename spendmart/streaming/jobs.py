"""Continuous ingest: landed transcript files and uploaded batches, folded into the stored table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendmart.operators.attribution import first_folders
from spendmart.operators.fold import fold_tags
from spendmart.operators.machines import merge_sync_state, sync_state
from spendmart.operators.validation import accepted_events, batch_counts, check_events, rejected_events
from spendmart.plans.ingest import ingest
from spendmart.session import materialize
from spendmart.sources.event_table import EventTable
from spendmart.sources.growing import stream_growing
from spendmart.sources.transcripts import stream_transcripts, with_order


BUCKETS = 64
NAMED = 1000  # session files a batch names to the scan of landed records, so that it skips others; only a speed-up
_MARKS = ["job", "batch"]
_PROJECT = ["machine_id", "project_dir"]
_SESSION = [*_PROJECT, "session_file"]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("machine_id", "session_file"), F.lit(BUCKETS)).cast("int")


def _keep(rows: DataFrame, path: str, job: str, batch_id: int, *more: str) -> None:
    """Stores a batch's rows under its own partition; a retried batch replaces it."""
    marked = rows.withColumn("job", F.lit(job)).withColumn("batch", F.lit(batch_id).cast("bigint"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_MARKS, *more).parquet(path)


def stored_tags(spark: SparkSession, table: EventTable) -> DataFrame:
    """(session_id, repo_key, name) of all batches: tags only accumulate, the latest name of a key wins."""
    kept = spark.read.parquet(f"{table.path}.tags")
    return fold_tags(kept.withColumn("seq", F.struct("batch", "job"))).drop("seq")


def _place_of_projects(spark: SparkSession, table: EventTable, batch: DataFrame, job: str, batch_id: int) -> DataFrame:
    """Where each project of the batch first recorded a folder: `first`, and `before` without this batch. Firsts only combine,
    so one small row per batch and project is all that is kept of them."""
    path = f"{table.path}.firsts"
    _keep(first_folders(batch.filter("_corrupt IS NULL")), path, job, batch_id)
    own = (F.col("job") == job) & (F.col("batch") == batch_id)
    known = spark.read.parquet(path).groupBy(*_PROJECT).agg(
        F.min("first").alias("first"), F.min(F.when(~own, F.col("first"))).alias("before"), F.bool_or(own).alias("_mine")
    )
    return known.filter("_mine").drop("_mine")


def _to_work_out(stored: DataFrame, batch: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, keys) that a batch can change: whole session files, and the messages among them to send.

    A session file stands alone but for two things. A project whose first folder has moved changes wherever it has no
    evidence of its own: all its files are taken. And a message may have copies in several files of a project, whose order
    decides: the files that share one are taken too, for those messages only; two id columns tell which.
    """
    named = batch.select(*_SESSION).distinct()
    moved = projects.filter(~F.col("before.cwd").eqNullSafe(F.col("first.cwd"))).select(*_PROJECT)
    if not moved.isEmpty():
        named = named.unionByName(stored.select(*_SESSION).join(moved, _PROJECT, "left_semi").distinct()).distinct()
    named = materialize(named, "named")
    key = [F.col("requestId").alias("request_id"), F.col("message.id").alias("message_id")]
    ids = stored.filter("type = 'assistant' AND requestId IS NOT NULL").select(*_SESSION, "bucket", *key)
    keys = materialize(_of_sessions(ids, named).select(*_PROJECT, "request_id", "message_id").distinct(), "keys")
    touched = named.select(*_PROJECT).distinct()
    sharing = ids.join(touched, _PROJECT, "left_semi").join(keys, [*_PROJECT, "request_id", "message_id"], "left_semi")
    wanted = materialize(named.unionByName(sharing.select(*_SESSION)).distinct(), "wanted")
    return _of_sessions(stored, wanted), keys.select("machine_id", "request_id", "message_id").distinct()


def _of_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """The rows of these session files; where they are few, their buckets and names reach the scan."""
    few = sessions.select("session_file", _bucket().alias("bucket")).distinct().limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        rows = rows.filter(F.col("bucket").isin(sorted({r.bucket for r in few})) & F.col("session_file").isin([r.session_file for r in few]))
    return rows.join(sessions, _SESSION, "left_semi")


def _counted(rows: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, watched: `counts` are taken while they are written, without a scan of their own."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def run_transcripts(
    spark: SparkSession,
    root: str,
    machine_id: str,
    table: EventTable,
    repos: DataFrame,
    ledger: DataFrame,
    prices: DataFrame,
    checkpoint: str,
    files_per_trigger: int = 1000,
    growing: bool = False,
) -> StreamingQuery:
    """Everything landed so far, then stop; call again to continue from the checkpoint.

    No watermark: late and re-sent rows must still correct history. What keeps a re-send harmless is
    the keyed fold, so each batch may be retried.

    A turn without evidence takes what its stream showed before, or what the project's first transcript shows. So landed
    records are kept next to the table, and the first folder of every project (`.firsts`). A batch works out the session
    files it touches anew, and others of a project only where they can change (see `_to_work_out`); how files are dealt
    to batches does not matter, and a project's history is not read again for a new file. Repository tags, rejected
    turns, torn lines and projects still without a fallback are kept too, under the table's path with the suffixes
    `.tags`, `.rejected`, `.torn` and `.skipped`; `.metrics` counts each batch (`transcript_metrics` sums them up).

    `growing`: files are still written to; each batch takes the lines completed since the last (all files in one batch). A
    message whose copies come in several batches keeps the instant of the first one stored, as any re-sent event does.
    """
    job = hashlib.md5(checkpoint.encode()).hexdigest()
    records = stream_growing(spark, root, machine_id) if growing else stream_transcripts(spark, root, machine_id, files_per_trigger)

    def merge(batch: DataFrame, batch_id: int) -> None:
        landed = f"{table.path}.landed"
        placed = batch if growing else with_order(batch)
        _keep(placed.withColumn("bucket", _bucket()), landed, job, batch_id, "bucket")
        stored = spark.read.parquet(landed)
        mine = stored.filter((F.col("job") == job) & (F.col("batch") == batch_id))
        projects = materialize(_place_of_projects(spark, table, mine, job, batch_id), "projects")
        again, keys = _to_work_out(stored, mine, projects)
        done = ingest(again.drop(*_MARKS, "bucket"), repos, ledger, prices, projects)
        sent_events = done.events.join(keys, ["machine_id", "request_id", "message_id"], "left_semi").select(*done.events.columns)
        rows = F.count(F.lit(1))
        events, sent = _counted(sent_events, events_sent=rows)
        merged = table.merge(events, F.col("ord"), job, batch_id)
        rejected, refused = _counted(done.rejected, events_rejected=rows)
        torn, broken = _counted(done.torn, lines_torn=rows)
        folders, walked = _counted(done.folders, files=F.coalesce(F.sum("files"), F.lit(0)), folders=rows, folders_skipped=F.count_if("skipped"))
        skipped = folders.filter("skipped").select("machine_id", "project_dir")
        for name, kept in (("tags", done.tags), ("rejected", rejected), ("torn", torn), ("skipped", skipped)):
            _keep(kept, f"{table.path}.{name}", job, batch_id)
        # a batch that was merged before its first attempt broke off is counted by itself
        counts = (sent.get if merged else {"events_sent": sent_events.count()}) | refused.get | broken.get | walked.get
        _keep(spark.range(1).select(*[F.lit(n).cast("bigint").alias(name) for name, n in counts.items()]), f"{table.path}.metrics", job, batch_id)

    return (
        records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def transcript_metrics(spark: SparkSession, table: EventTable) -> DataFrame:
    """One row per job and batch: files, folders, skipped folders, events sent and rejected, torn lines, of the session files it worked out."""
    return spark.read.parquet(f"{table.path}.metrics")


def run_wire(
    uploads: DataFrame, table: EventTable, checkpoint: str, on_rejected: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Uploaded entries (machine_id, position, raw JSON; received_at and is_backfill where known) checked one by one and folded.

    Rejects are kept with their reasons under the table's path with the suffix `.refused`, and go to `on_rejected` as well;
    who made contact, and with how many entries, is kept under `.contacts`. A retried batch replaces its own rows.
    """
    job = hashlib.md5(checkpoint.encode()).hexdigest()

    def merge(batch: DataFrame, batch_id: int) -> None:
        if "received_at" not in batch.columns:
            batch = batch.withColumn("received_at", F.current_timestamp().cast("timestamp_ntz"))
        if "is_backfill" not in batch.columns:
            batch = batch.withColumn("is_backfill", F.lit(False))
        checked = check_events(batch)
        table.merge(accepted_events(checked, "machine_id", "position"), F.col("position"), job, batch_id)
        rejected = rejected_events(checked)
        _keep(rejected, f"{table.path}.refused", job, batch_id)
        counted = batch_counts(checked, "machine_id", "received_at", F.coalesce("is_backfill", F.lit(False)).alias("is_backfill"))
        _keep(counted.withColumn("events", F.col("accepted") + F.col("rejected")), f"{table.path}.contacts", job, batch_id)
        if on_rejected is not None:
            on_rejected(rejected, batch_id)

    return uploads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_sync_state(spark: SparkSession, table: EventTable, before: DataFrame | None = None) -> DataFrame:
    """(machine_id, last_contact_at, last_accepted_at) from all stored contacts, and from an older state where there is one."""
    fresh = sync_state(spark.read.parquet(f"{table.path}.contacts"))
    return fresh if before is None else merge_sync_state(before, fresh)


def sync_state_stream(batches: DataFrame) -> DataFrame:
    """Per-machine contact times over a stream of upload records, for `update` output: one small state row per machine."""
    return sync_state(batches)
