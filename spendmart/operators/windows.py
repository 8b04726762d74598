"""Which window a request asks for, and the grid of days or bars it spans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendmart.functions import bars, clock
from spendmart.operators.filters import Instant, instant
from spendmart.schemas import DASHBOARD_ZONE

PRESET_DAYS = {"today": 1, "7d": 7, "30d": 30, "90d": 90}
ALL_TIME, CUSTOM = "all", "custom"
DEFAULT_PRESET = "30d"
LOOKBACK_DAYS = 365


def earliest_event(events: DataFrame) -> DataFrame:
    """One row with the first instant on record, NULL when there is none."""
    return events.agg(F.min("ts").alias("earliest"))


def window_of(
    earliest: DataFrame,
    now: Instant,
    preset: str | None = None,
    from_day: str | None = None,
    to_day: str | None = None,
    zone: str = DASHBOARD_ZONE,
) -> DataFrame:
    """One row: preset, from_ts, to_ts, fell_back. Stays lazy: feed `bound(window, ...)` to a range filter."""
    at = instant(now)
    first_midnight = clock.day_start(F.col("earliest"), zone)
    low_day, high_day = _real_day(from_day), _real_day(to_day)
    supplied = from_day is not None or to_day is not None
    custom = F.coalesce(low_day <= high_day, F.lit(False))
    known = preset in PRESET_DAYS or preset == ALL_TIME
    all_time_asked = preset == ALL_TIME
    fell_back = ~custom & (F.lit((preset is not None and not known) or supplied) | (F.lit(all_time_asked) & F.col("earliest").isNull()))
    span = lambda days: clock.day_start(at - F.expr(f"interval {days - 1} days"), zone)
    requested = F.lit(preset if known else DEFAULT_PRESET)
    chosen = F.when(custom, CUSTOM).when(fell_back, DEFAULT_PRESET).otherwise(requested)
    start = F.when(custom, clock.midnight(low_day, zone)).when(chosen == ALL_TIME, first_midnight)
    for name, days in PRESET_DAYS.items():
        start = start.when(chosen == name, span(days))
    end = F.when(custom, clock.last_millisecond(high_day, zone)).otherwise(at)
    return earliest.select(
        chosen.alias("preset"),
        F.greatest(start, first_midnight).alias("from_ts"),
        F.least(end, at).alias("to_ts"),
        fell_back.alias("fell_back"),
    )


def _real_day(text: str | None) -> Column:
    """A calendar day written `yyyy-MM-dd`, NULL for anything else."""
    column = F.lit(text).cast("string")
    return F.when(column.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), column.try_cast("date"))


def bound(window: DataFrame, name: str) -> Column:
    """`from_ts` or `to_ts` of a one-row window as a scalar subquery: no collect, and the scan still sees a constant."""
    return window.select(name).scalar()


def lookback(window: DataFrame, now: Instant) -> DataFrame:
    """The wide window colours are ranked over."""
    at = instant(now)
    return window.select(
        F.least(F.col("from_ts"), at - F.expr(f"interval {LOOKBACK_DAYS} days")).alias("from_ts"), at.alias("to_ts")
    )


def day_bars(window: DataFrame, zone: str = DASHBOARD_ZONE) -> DataFrame:
    """(day, bar, label) for each local day of a one-row window (from_ts, to_ts)."""
    ends = window.select(
        clock.local_date(F.col("from_ts"), zone).alias("first_day"), clock.local_date(F.col("to_ts"), zone).alias("last_day")
    )
    days = ends.select("first_day", "last_day", F.explode(F.sequence("first_day", "last_day")).alias("_day"))
    count = (F.datediff("last_day", "first_day") + 1).cast("bigint")
    position = F.datediff("_day", "first_day").cast("bigint")
    return days.select(
        F.date_format("_day", "yyyy-MM-dd").alias("day"),
        bars.bar_of(position, count).alias("bar"),
        bars.day_bar_label(F.col("_day"), F.col("first_day"), F.col("last_day")).alias("label"),
    )


def bar_labels(spark: SparkSession, first_day: dt.date | str, last_day: dt.date | str) -> DataFrame:
    """(bar, day) of the at most twenty bars over a window of known days; `day` holds the bar's label."""
    low, high = _day(first_day), _day(last_day)
    days = spark.range((high - low).days + 1).select(F.col("id"), F.date_add(F.lit(low), F.col("id").cast("int")).alias("_day"))
    labelled = days.select(
        bars.bar_of(F.col("id"), (high - low).days + 1).alias("bar"), bars.day_bar_label(F.col("_day"), low, high).alias("day")
    )
    return labelled.distinct()


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def fill_bars(rows: DataFrame, grid: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Every bar of the grid once per existing row, or one row of defaults. Existing rows are never overwritten."""
    filled = grid.join(rows, "day", "left")
    columns = [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if defaults.get(c) is not None else F.col(c) for c in rows.columns if c != "day"]
    return filled.select("bar", "day", *columns)
