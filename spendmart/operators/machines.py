"""Machines: sync state, display names, the roster and its freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.functions import clock, names
from spendmart.operators.filters import Instant, instant
from spendmart.schemas import DASHBOARD_ZONE

STALE_AFTER = "interval 12 hours"
SKEW_ALLOWED = "interval 5 minutes"


def sync_state(batches: DataFrame) -> DataFrame:
    """Latest live contact and latest live delivery per machine; empty batches and backfills say nothing about health.

    `batches`: machine_id, received_at, events, accepted, is_backfill. Maxima, so order of arrival does not matter.
    """
    live = batches.filter((F.col("events") > 0) & ~F.col("is_backfill"))
    return live.groupBy("machine_id").agg(
        F.max("received_at").alias("last_contact_at"),
        F.max(F.when(F.col("accepted") > 0, F.col("received_at"))).alias("last_accepted_at"),
    )


def merge_sync_state(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    both = stored.select("machine_id", "last_contact_at", "last_accepted_at").unionByName(fresh)
    return both.groupBy("machine_id").agg(
        F.max("last_contact_at").alias("last_contact_at"), F.max("last_accepted_at").alias("last_accepted_at")
    )


def machine_roster(events: DataFrame, state: DataFrame) -> DataFrame:
    """Every machine that has events or a state row; combined per machine before the join."""
    seen = events.filter(F.col("machine_id").isNotNull()).select(F.col("machine_id").alias("_seen")).distinct()
    joined = state.join(seen, state["machine_id"] == seen["_seen"], "full_outer")
    return joined.withColumn("machine_id", F.coalesce("machine_id", "_seen")).drop("_seen")


def check_names(feed: DataFrame) -> DataFrame:
    """Cleans a names feed (machine_id, name, seq) and says which entries may be stored."""
    return feed.withColumn("cleaned", names.clean_name(F.col("name"))).withColumn(
        "allowed", F.coalesce(names.name_allowed(F.col("cleaned")), F.lit(False))
    )


def latest_names(feed: DataFrame, roster: DataFrame) -> DataFrame:
    """The name each known machine ends up with; NULL where the last entry cleared it."""
    known = check_names(feed).filter("allowed").join(roster.select("machine_id").distinct(), "machine_id", "left_semi")
    last = known.groupBy("machine_id").agg(F.max_by("cleaned", "seq").alias("name"))
    return last.withColumn("name", F.nullif("name", F.lit("")))


def machine_status(roster: DataFrame, display: DataFrame | None, now: Instant, zone: str = DASHBOARD_ZONE) -> DataFrame:
    """Contact times and the staleness flag. A machine never heard from is not stale; a contact in the future is."""
    named = (
        roster.join(display.select(F.col("machine_id").alias("_id"), "name"), F.col("machine_id") == F.col("_id"), "left").drop("_id")
        if display is not None
        else roster.withColumn("name", F.lit(None).cast("string"))
    )
    elapsed = instant(now) - F.col("last_contact_at")
    stale = (elapsed < -F.expr(SKEW_ALLOWED)) | (elapsed >= F.expr(STALE_AFTER))
    shown = lambda column: F.coalesce(clock.format_instant(F.col(column), zone), F.lit("never"))
    return named.select(
        "machine_id",
        "name",
        names.display_name(F.col("name"), F.col("machine_id")).alias("display_name"),
        shown("last_contact_at").alias("last_contact"),
        shown("last_accepted_at").alias("last_accepted"),
        F.coalesce(stale, F.lit(False)).alias("stale"),
    )
