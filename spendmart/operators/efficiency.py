"""Cache savings, model mix, subagent share and month-to-date spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendmart.functions import clock, money
from spendmart.operators.filters import Instant, in_range, instant
from spendmart.operators.pricing import cache_savings
from spendmart.operators.splits import OTHER, dimension_value, label_series, top_labels
from spendmart.schemas import DASHBOARD_ZONE, Dimension
from spendmart.session import materialize

EFFICIENCY_SUMS = [
    "cost_micro",
    "subagent_micro",
    "event_count",
    "subagent_events",
    "unpriced_events",
    "input_tokens",
    "cache_read_tokens",
    "cache_write_5m_tokens",
    "cache_write_1h_tokens",
]
SAVINGS_SUMS = ["gross_micro", "premium_micro", "net_micro"]


def efficiency_by_model(
    events: DataFrame, prices: DataFrame, start: Instant, end: Instant, zone: str = DASHBOARD_ZONE
) -> DataFrame:
    """One row per local day and model. Savings are priced per UTC day inside it, before the days merge."""
    cost = money.gated(F.col("cost_micro"), F.col("priced"))
    window = in_range(events, start, end).select(
        clock.day_key(F.col("ts"), zone).alias("day"),
        F.col("ts").cast("date").alias("utc_day"),
        dimension_value(Dimension.MODEL).alias("model"),
        cost.alias("cost_micro"),
        "priced",
        "is_subagent",
        "input_tokens",
        "cache_read_tokens",
        "cache_write_5m_tokens",
        "cache_write_1h_tokens",
    )
    fine = window.groupBy("day", "utc_day", "model").agg(
        F.sum("cost_micro").alias("cost_micro"),
        F.coalesce(F.sum(F.when(F.col("is_subagent"), F.col("cost_micro"))), F.lit(0)).alias("subagent_micro"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if("is_subagent").alias("subagent_events"),
        F.sum(money.unpriced(F.col("priced"))).alias("unpriced_events"),
        *[F.sum(c).alias(c) for c in EFFICIENCY_SUMS[5:]],
    )
    dated = fine.withColumn("utc_start", F.col("utc_day").cast("timestamp_ntz"))
    saved = cache_savings(dated, prices, "model", "utc_start")
    return saved.groupBy("day", "model").agg(
        *[F.sum(c).alias(c) for c in EFFICIENCY_SUMS + SAVINGS_SUMS], F.bool_and("savings_known").alias("savings_known")
    )


def efficiency_by_day(by_model: DataFrame) -> DataFrame:
    """Roll-up to the day (or to the bar, when the days were re-keyed first)."""
    return by_model.groupBy("day").agg(*[F.sum(c).alias(c) for c in EFFICIENCY_SUMS])


def savings_by_day(by_model: DataFrame) -> DataFrame:
    """One unpriced model makes the whole day a floor."""
    return by_model.groupBy("day").agg(
        F.sum("gross_micro").alias("gross_micro"),
        F.sum("net_micro").alias("net_micro"),
        F.bool_and("savings_known").alias("savings_known"),
        F.sum("event_count").alias("event_count"),
    )


def savings_summary(daily: DataFrame) -> DataFrame:
    """One row: net saving of the window, whether it is only a floor, and the sentence saying so."""
    total = daily.agg(
        F.coalesce(F.sum("net_micro"), F.lit(0)).alias("net_micro"),
        (~F.coalesce(F.bool_and("savings_known"), F.lit(True))).alias("is_floor"),
    )
    return total.withColumn("statement", money.savings_text(money.dollars(F.col("net_micro")), F.col("is_floor")))


def model_mix(by_model: DataFrame, top: DataFrame) -> DataFrame:
    """Share of each day's priced spend per shown model and `Other`, in long form.

    NULL on a day that spent nothing, 0 for a shown model idle on a spending day.
    """
    rows = by_model.withColumnRenamed("model", "label")
    series = label_series(rows, top).groupBy("day", "series", "is_other").agg(
        F.sum("cost_micro").alias("cost_micro"), F.sum("event_count").alias("event_count")
    )
    day = W.partitionBy("day")
    totals = series.withColumn("_day_micro", F.sum("cost_micro").over(day)).withColumn("day_events", F.sum("event_count").over(day))
    share = F.when(F.col("_day_micro") != 0, F.col("cost_micro").cast("double") / F.col("_day_micro").cast("double"))
    return totals.select("day", "series", "is_other", share.alias("share"), "day_events")


def dense_mix(mix: DataFrame, top: DataFrame) -> DataFrame:
    """Adds the rows of shown models that were idle on a day: 0 on a spending day, NULL otherwise.

    Each day is completed from the shown labels, at most `TOP_SERIES` + 1 of them, carried as one array.
    """
    shown = top.agg(F.sort_array(F.collect_list(F.struct(F.lit(False).alias("is_other"), F.col("label").alias("series")))).alias("_shown"))
    per_day = mix.groupBy("day").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("is_other", "series"), "share"))).alias("_shares"),
        F.max("day_events").alias("day_events"),
        F.bool_or(F.col("share").isNotNull()).alias("_spent"),
    )
    other = F.array(F.struct(F.lit(True).alias("is_other"), F.lit(OTHER).alias("series")))
    any_other = mix.agg(F.coalesce(F.bool_or("is_other"), F.lit(False)).alias("x")).scalar()
    keys = F.concat(shown.scalar(), F.when(any_other, other).otherwise(F.array().cast("array<struct<is_other:boolean,series:string>>")))
    completed = per_day.withColumn("_key", F.explode(keys))
    share = F.coalesce(F.try_element_at("_shares", F.col("_key")), F.when(F.col("_spent"), F.lit(0.0)))
    return completed.select("day", F.col("_key.series").alias("series"), F.col("_key.is_other").alias("is_other"), share.alias("share"), "day_events")


def mix_of_top(by_model: DataFrame) -> DataFrame:
    """Shares of the dearest models of the window and `Other`. The mart is read several times, so it is written out once."""
    kept = materialize(by_model, "by-model")
    top = materialize(top_labels(kept.withColumnRenamed("model", "label")), "top")
    return dense_mix(model_mix(kept, top), top)


def subagent_share(cost_micro: Column, subagent_micro: Column, subagent_events: Column) -> Column:
    """NULL without spend, and when subagents ran but only on unpriced models."""
    unknown = (cost_micro == 0) | ((subagent_micro == 0) & (subagent_events > 0))
    return F.when(~unknown, subagent_micro.cast("double") / cost_micro.cast("double"))


def share_percent(share: Column) -> Column:
    """One decimal of a percentage, halves up."""
    return F.floor(share * 1000 + F.lit(0.5)) / F.lit(10.0)


def with_subagent_share(daily: DataFrame) -> DataFrame:
    share = subagent_share(F.col("cost_micro"), F.col("subagent_micro"), F.col("subagent_events"))
    return daily.withColumn("share", share).withColumn("share_percent", share_percent(F.col("share")))


def month_to_date(events: DataFrame, now: Instant, zone: str = DASHBOARD_ZONE) -> DataFrame:
    """One row: today, the month so far, and where the month is heading (NULL on the 1st)."""
    at = instant(now)
    today = clock.local_date(at, zone)
    window = in_range(events, clock.month_start(at, zone), at)
    is_today = clock.local_date(F.col("ts"), zone) == today
    cost, lost = money.gated(F.col("cost_micro"), F.col("priced")), money.unpriced(F.col("priced"))
    zero = F.lit(0)
    sums = window.agg(
        F.coalesce(F.sum(F.when(is_today, cost)), zero).alias("today_micro"),
        F.coalesce(F.sum(F.when(is_today, lost)), zero).alias("today_unpriced"),
        F.coalesce(F.sum(cost), zero).alias("month_micro"),
        F.coalesce(F.sum(lost), zero).alias("month_unpriced"),
    )
    return (
        sums.withColumn("complete_days", (F.day(today) - 1).cast("bigint"))
        .withColumn("days_in_month", F.day(F.last_day(today)).cast("bigint"))
        .withColumn("month_usd", money.dollars(F.col("month_micro")))
        .withColumn(
            "projected_usd",
            F.when(F.col("complete_days") > 0, F.try_divide("month_usd", "complete_days") * F.col("days_in_month")),
        )
        .withColumn("today_usd", money.dollars(F.col("today_micro")))
        .select("today_usd", "today_unpriced", "month_usd", "month_unpriced", "complete_days", "days_in_month", "projected_usd")
    )
