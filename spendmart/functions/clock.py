"""Instants, calendar days in a zone, and ISO-8601 parsing. All on TIMESTAMP_NTZ holding UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_zone(ts: Column, zone: str) -> Column:
    """Wall clock of a UTC instant in a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_zone(wall: Column, zone: str) -> Column:
    """UTC instant of a wall clock in a zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def local_date(ts: Column, zone: str) -> Column:
    return to_zone(ts, zone).cast("date")


def day_key(ts: Column, zone: str = "UTC") -> Column:
    """`yyyy-MM-dd` of an instant in a zone."""
    return (ts.cast("date") if zone == "UTC" else local_date(ts, zone)).cast("string")


def midnight(day: Column, zone: str) -> Column:
    """UTC instant at which a calendar day starts in a zone."""
    return from_zone(day.cast("timestamp_ntz"), zone)


def day_start(ts: Column, zone: str) -> Column:
    return midnight(local_date(ts, zone), zone)


def day_end(ts: Column, zone: str) -> Column:
    """Last millisecond of the local day."""
    return last_millisecond(local_date(ts, zone), zone)


def last_millisecond(day: Column, zone: str) -> Column:
    return midnight(F.date_add(day, 1), zone) - F.expr("interval 1 millisecond")


def month_start(ts: Column, zone: str) -> Column:
    return midnight(F.trunc(local_date(ts, zone), "month"), zone)


def format_instant(ts: Column, zone: str) -> Column:
    return F.substring(to_zone(ts, zone).cast("string"), 1, 19)


def minute_of(ts: Column) -> Column:
    """`yyyy-MM-dd HH:mm`: grows with the instant, so it can serve as a block of an ordered operator."""
    return F.substring(ts.cast("string"), 1, 16)


ISO_INSTANT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.][0-9]{1,9})?)?))?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?\z"
)


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to a UTC instant, NULL when it is not one. No offset means UTC."""
    day = F.regexp_extract(text, ISO_INSTANT, 1)
    time = F.regexp_extract(text, ISO_INSTANT, 2)
    offset = F.regexp_extract(text, ISO_INSTANT, 3)
    wall = F.concat(day, F.lit(" "), F.when(time == "", "00:00").otherwise(time)).try_cast("timestamp_ntz")
    minutes = F.when(
        offset.rlike("^[+-]"),
        (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, -2, 2).cast("int"))
        * F.when(offset.startswith("-"), -1).otherwise(1),
    ).otherwise(0)
    shifted = wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.when(text.rlike(ISO_INSTANT), shifted)
