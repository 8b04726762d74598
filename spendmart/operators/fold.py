"""Mergeable state of re-sent rows: folding is associative, commutative and idempotent.

`seq` orders arrivals, for example struct(batch, position). State keeps the winning `seq` next to each
column group, so new rows fold into stored state with the same aggregation that built it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.schemas import COUNTERS, OPTIONAL_TEXT

KEY = ["request_id", "message_id"]
OWNER = ["session_id", "machine_id", "model", "ts", "is_subagent"]
RAISED = [*COUNTERS, "cost_micro"]
LATEST = ["project_slug", "priced"]


def _first(seq: Column, owner) -> Column:
    return F.struct(seq.alias("seq"), *owner)


def _latest(seq: Column, latest) -> Column:
    return F.struct(seq.alias("seq"), *latest)


def _given(seq: Column, name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct(seq.alias("seq"), F.col(name).alias("value")))


def to_state(events: DataFrame, seq: Column, owner=OWNER, raised=RAISED, latest=LATEST, optional=OPTIONAL_TEXT, key=KEY) -> DataFrame:
    """Each arriving row as a state of its own."""
    stamped, seq = events.withColumn("_seq", seq), F.col("_seq")
    return stamped.select(
        *key, _first(seq, owner).alias("first"), *raised, _latest(seq, latest).alias("last"), *[_given(seq, c).alias(c) for c in optional]
    )


def fold(states: DataFrame, raised=RAISED, optional=OPTIONAL_TEXT, key=KEY, also=()) -> DataFrame:
    """One state per key: first owner, highest counters, last setting, last value that was present; `also`: further aggregates.

    All min/max, so copies of one key are combined on the map side and no key is hot after it.
    """
    return states.groupBy(*key).agg(
        F.min("first").alias("first"),
        *[F.max(c).alias(c) for c in raised],
        F.max("last").alias("last"),
        *[F.max(c).alias(c) for c in optional],
        *also,
    )


def fold_events(events: DataFrame, seq: Column, owner=OWNER, raised=RAISED, latest=LATEST, optional=OPTIONAL_TEXT, key=KEY) -> DataFrame:
    """fold(to_state(events)), for rows that are already dealt by key: they are sorted as they are, not as states."""
    return events.groupBy(*key).agg(
        F.min(_first(seq, owner)).alias("first"),
        *[F.max(c).alias(c) for c in raised],
        F.max(_latest(seq, latest)).alias("last"),
        *[F.max(_given(seq, c)).alias(c) for c in optional],
    )


def compact(states: DataFrame, owner=OWNER, raised=RAISED, latest=LATEST, optional=OPTIONAL_TEXT, key=KEY) -> DataFrame:
    """States as they are stored and sent: a `seq` equal to that of `last` is left out. Most keys arrive once, with one seq."""
    last = F.col("last.seq")
    seq = lambda c: F.when(F.col(f"{c}.seq") != last, F.col(f"{c}.seq"))
    short = lambda c: F.when(F.col(c).isNotNull(), F.struct(seq(c).alias("seq"), F.col(f"{c}.value").alias("value")))
    return states.select(
        *key, _first(seq("first"), [f"first.{c}" for c in owner]).alias("first"), *raised, "last", *[short(c).alias(c) for c in optional]
    )


def whole(states: DataFrame, owner=OWNER, raised=RAISED, latest=LATEST, optional=OPTIONAL_TEXT, key=KEY) -> DataFrame:
    """compact() undone; states that were never compact stay as they are."""
    seq = lambda c: F.coalesce(f"{c}.seq", "last.seq")
    full = lambda c: F.when(F.col(c).isNotNull(), F.struct(seq(c).alias("seq"), F.col(f"{c}.value").alias("value")))
    return states.select(
        *key, _first(seq("first"), [f"first.{c}" for c in owner]).alias("first"), *raised, "last", *[full(c).alias(c) for c in optional]
    )


def plain_column(name: str, owner=OWNER, latest=LATEST, optional=OPTIONAL_TEXT) -> Column:
    """A column of the plain row, from a state."""
    return F.col(f"first.{name}" if name in owner else f"last.{name}" if name in latest else f"{name}.value" if name in optional else name)


def from_state(states: DataFrame, owner=OWNER, raised=RAISED, latest=LATEST, optional=OPTIONAL_TEXT, key=KEY) -> DataFrame:
    """State back to plain rows."""
    return states.select(
        *key,
        *[F.col(f"first.{c}").alias(c) for c in owner],
        *raised,
        *[F.col(f"last.{c}").alias(c) for c in latest],
        *[F.col(f"{c}.value").alias(c) for c in optional],
    )


def upsert(events: DataFrame, seq: Column) -> DataFrame:
    """The stored table after all of `events` arrived in `seq` order."""
    return from_state(fold(to_state(events, seq)))


def fold_tags(reports: DataFrame) -> DataFrame:
    """(session_id, repo_key, name) after reports (…, seq): tags only accumulate, the latest name of a key wins."""
    return reports.groupBy("session_id", "repo_key").agg(F.max(F.struct("seq", "name")).alias("_last")).select(
        "session_id", "repo_key", F.col("_last.name").alias("name"), F.col("_last.seq").alias("seq")
    )


def tags_as_map(tags: DataFrame) -> DataFrame:
    """One row per session with its repositories as a map, for readers who want that shape."""
    return tags.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("repo_key", "name"))).alias("repos"))


def ingest_metrics(batches: DataFrame) -> DataFrame:
    """One row per run: files, requests, events sent and rejected, failed uploads, skipped folders.

    `batches`: run_id, file, events, accepted, folder, skipped; a skipped folder is a row of its own without events.
    """
    return batches.groupBy("run_id").agg(
        F.count_distinct("file").alias("files"),
        F.count_if(F.col("events") > 0).alias("requests"),
        F.sum("accepted").alias("events_sent"),
        F.sum(F.col("events") - F.col("accepted")).alias("events_rejected"),
        F.count_if((F.col("events") > 0) & (F.col("accepted") == 0)).alias("failures"),
        F.count_distinct(F.when(F.col("skipped"), F.col("folder"))).alias("folders_skipped"),
    )
