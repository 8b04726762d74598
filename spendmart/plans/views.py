"""What each dashboard card shows, composed from the operators.

The charts and the mix write their day rows out once, at the time they are built; the rest is lazy. The caller
collects the few final rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.functions import clock, money, names
from spendmart.operators import efficiency, splits, windows
from spendmart.schemas import DASHBOARD_ZONE
from spendmart.session import materialize


def with_display_names(rows: DataFrame, machine: str, nicknames: DataFrame | None) -> DataFrame:
    """Adds `display_name` of a machine column; a machine without a nickname shows its short id."""
    if nicknames is None:
        return rows.withColumn("display_name", names.display_name(F.lit(None).cast("string"), F.col(machine)))
    known = nicknames.select(F.col("machine_id").alias("_id"), F.col("name").alias("_name"))
    joined = rows.join(known, F.col(machine) == F.col("_id"), "left")
    return joined.withColumn("display_name", names.display_name(F.col("_name"), F.col(machine))).drop("_id", "_name")


def totals_table(rows: DataFrame, domain: DataFrame) -> DataFrame:
    """Every label of the window with its totals and colour slot; NULL slot means it is part of `Other`."""
    rows = materialize(rows, "daily")
    # at most TOP_SERIES rows by construction
    slots = F.broadcast(splits.series_slots(splits.top_labels(rows), domain).select(F.col("label").alias("_label"), "slot"))
    totals = rows.groupBy("label").agg(*splits.merged_sums())
    return totals.join(slots, F.col("label") == F.col("_label"), "left").drop("_label")


def cost_chart(rows: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """One row per bar: its spend per shown series as an array in rank order, and for `Other`; bars without events are kept.

    Ranked on the raw days, re-keyed before the sums, filled last.
    """
    series = splits.series_chart(rows, first_day, last_day)
    per_bar = series.groupBy("day").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("is_other"), F.struct("series", "cost_micro")))).alias("shown"),
        F.sum(F.when(F.col("is_other"), F.col("cost_micro"))).alias("other_micro"),
        F.sum("unpriced_events").alias("unpriced_events"),
        F.sum("event_count").alias("event_count"),
    )
    grid = windows.bar_labels(rows.sparkSession, first_day, last_day)
    return windows.fill_bars(per_bar, grid, {"unpriced_events": 0, "event_count": 0})


def savings_card(by_model: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Savings per bar; an empty bar saved nothing and is known to have."""
    daily = efficiency.savings_by_day(splits.bucket_rows(by_model, first_day, last_day))
    grid = windows.bar_labels(by_model.sparkSession, first_day, last_day)
    return windows.fill_bars(daily, grid, {"savings_known": True, "event_count": 0})


def mix_card(by_model: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Model shares per bar, ranked over the window; shares of sums, not means of shares. An empty bar has no shares."""
    mix = efficiency.mix_of_top(splits.bucket_rows(by_model, first_day, last_day))
    return windows.fill_bars(mix, windows.bar_labels(by_model.sparkSession, first_day, last_day), {"day_events": 0})


def kpi_card(month: DataFrame) -> DataFrame:
    """The three tiles as text, from `month_to_date`."""
    day = F.when(F.col("complete_days") == 1, "day").otherwise("days")
    return month.select(
        money.lower_bound_text(F.col("today_usd"), F.col("today_unpriced")).alias("today"),
        money.lower_bound_text(F.col("month_usd"), F.col("month_unpriced")).alias("month"),
        F.coalesce(money.lower_bound_text(F.col("projected_usd"), F.col("month_unpriced")), F.lit("Not enough data yet")).alias("projected"),
        F.when(
            F.col("projected_usd").isNotNull(),
            F.concat(F.lit("Projected from "), F.col("complete_days"), F.lit(" complete "), day, F.lit(" of "), F.col("days_in_month")),
        ).otherwise("No day has fully ended this month yet").alias("projected_note"),
    )


def session_table(page: DataFrame, nicknames: DataFrame | None, zone: str = DASHBOARD_ZONE) -> DataFrame:
    """The rows of a session list as shown; the whole-session cost appears only where it differs."""
    shown = with_display_names(page, "machine_id", nicknames)
    differs = F.col("total_micro") != F.col("cost_micro")
    whole = money.lower_bound_text(money.dollars(F.col("total_micro")), F.col("total_unpriced"))
    return shown.select(
        "session_id",
        F.coalesce("session_title", names.short_id(F.col("session_id"))).alias("name"),
        F.col("project_slug").alias("project"),
        F.col("display_name").alias("machine"),
        F.array_join("models", ", ").alias("models"),
        clock.format_instant(F.col("started_at"), zone).alias("started"),
        "event_count",
        money.lower_bound_text(money.dollars(F.col("cost_micro")), F.col("unpriced_events")).alias("cost"),
        F.when(differs, F.concat(F.lit("whole session "), whole)).alias("whole_session"),
    )


def machine_tile(status: DataFrame) -> DataFrame:
    """Machines ordered by the name they show."""
    return status.orderBy("display_name", "machine_id")
