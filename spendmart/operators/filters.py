"""Predicates shared by every windowed read."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = Column | dt.datetime | str


def instant(value: Instant) -> Column:
    """A UTC instant as a Column: a Column passes through, text and naive datetimes become literals."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def in_range(events: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """Inclusive on both ends. Where the table is partitioned by UTC date, the partitions are pruned too."""
    low, high = instant(start), instant(end)
    kept = events.filter((F.col("ts") >= low) & (F.col("ts") <= high))
    if "event_date" in events.columns:
        kept = kept.filter((F.col("event_date") >= low.cast("date")) & (F.col("event_date") <= high.cast("date")))
    return kept
