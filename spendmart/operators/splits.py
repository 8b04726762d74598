"""Cost per local day by machine, model, project or repository, and the labels of repositories.

Each split reads the events once: everything after the first aggregation works on rows of the
size of the answer, so labels and totals come from windows over those rows, not from a second scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendmart.functions import bars, clock, money
from spendmart.functions.models import normalize_model
from spendmart.operators.filters import Instant, in_range
from spendmart.schemas import DASHBOARD_ZONE, UNATTRIBUTED, Dimension
from spendmart.session import materialize

TOP_SERIES = 5
OTHER = "Other"
LOOKBACK_DAYS = 365


def spend_sums() -> list[Column]:
    """The three measures every split carries. Dollars are gated on `priced`, counts are not."""
    return [
        F.sum(money.gated(F.col("cost_micro"), F.col("priced"))).alias("cost_micro"),
        F.sum(money.unpriced(F.col("priced"))).alias("unpriced_events"),
        F.count(F.lit(1)).alias("event_count"),
    ]


def merged_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("cost_micro", "unpriced_events", "event_count")]


def dimension_value(dimension: Dimension) -> Column:
    """The stored column a row is split by, normalised; NULL becomes its own named value."""
    column = F.col("project_slug" if dimension is Dimension.REPO else dimension.value)
    return F.coalesce(normalize_model(column) if dimension is Dimension.MODEL else column, F.lit(UNATTRIBUTED))


def cost_per_day(
    events: DataFrame,
    dimension: Dimension,
    start: Instant,
    end: Instant,
    tags: DataFrame | None = None,
    zone: str = DASHBOARD_ZONE,
) -> DataFrame:
    """(day, label, cost_micro, unpriced_events, event_count) for the window."""
    window = in_range(events, start, end).withColumn("day", clock.day_key(F.col("ts"), zone))
    if dimension is Dimension.REPO:
        rows = merge_repositories(repo_rows(window, tags, "day"), ["day"])
    elif dimension is Dimension.PROJECT:
        rows = merge_projects(project_rows(window, ["day"]), ["day"])
    else:
        rows = window.groupBy("day", dimension_value(dimension).alias("label")).agg(*spend_sums())
    return rows.select("day", "label", "cost_micro", "unpriced_events", "event_count")


def _with_newest_name(window: DataFrame, *keys) -> DataFrame:
    """Sums per key, with the last repository name in byte order.

    The raw rows are grouped by the name as well, so that they meet nothing but sums (hash aggregation); the
    maximum of a text, which needs sorted rows, is taken over what is left.
    """
    names = [k if isinstance(k, str) else k[0] for k in keys]
    columns = [F.col(k) if isinstance(k, str) else k[1].alias(k[0]) for k in keys]
    summed = window.groupBy(*columns, "repo_name").agg(*spend_sums())
    return summed.groupBy(*names).agg(*merged_sums(), F.max("repo_name").alias("repo_name"))


def project_rows(window: DataFrame, grain: list[str]) -> DataFrame:
    """Spend per folder and repository. The repository key is grouped on, so a folder holding several keeps them apart."""
    return _with_newest_name(window, *grain, ("slug", dimension_value(Dimension.PROJECT)), "repo_key")


def with_repo_label(rows: DataFrame) -> DataFrame:
    """Adds `member` (repository, or folder where there is none) and its one `label` for the whole window.

    A recorded main-checkout name beats any folder name; then most events, shortest, alphabetical. Names are tallied by
    aggregates that combine before the shuffle, so a repository met in very many folders fills no single task. `rows`
    are already aggregated; they are written out because tallies and answer both read them.
    """
    member = F.when(F.col("repo_key").isNotNull(), F.concat(F.lit("repo:"), F.col("repo_key"))).otherwise(
        F.concat(F.lit("slug:"), F.col("slug"))
    )
    keyed = materialize(rows.withColumn("member", member), "label-rows")
    names = F.array(
        F.struct(F.lit(0).alias("tier"), F.col("repo_name").alias("name")), F.struct(F.lit(1).alias("tier"), F.col("slug").alias("name"))
    )
    named = keyed.filter(F.col("repo_key").isNotNull()).select("member", "event_count", F.inline(names))
    tallies = named.filter("tier = 1 OR name IS NOT NULL").groupBy("member", "tier", "name").agg(F.sum("event_count").alias("n"))
    best = tallies.groupBy("member").agg(F.min(F.struct("tier", (-F.col("n")).alias("fewest"), F.length("name").alias("size"), "name")).alias("_best"))
    joined = keyed.join(best, "member", "left")
    return joined.withColumn("label", F.when(F.col("repo_key").isNull(), F.col("slug")).otherwise(F.col("_best.name"))).drop("_best")


def merge_projects(rows: DataFrame, grain: list[str]) -> DataFrame:
    """One row per repository under its label; folders without a repository stand alone."""
    return with_repo_label(rows).groupBy("member", *grain, "label", "repo_key").agg(*merged_sums())


def session_parts(window: DataFrame, grain: list[str]) -> DataFrame:
    """Events grouped down to sessions before any tag is looked up."""
    return _with_newest_name(window, "session_id", *grain, "repo_key", ("slug", dimension_value(Dimension.PROJECT)))


def repo_rows(window: DataFrame, tags: DataFrame | None, *grain: str) -> DataFrame:
    """A tagged session's whole spend once under every tag; an untagged one under each event's own repository."""
    return spread_tags(session_parts(window, list(grain)), tags, *grain)


def spread_tags(parts: DataFrame, tags: DataFrame | None, *grain: str) -> DataFrame:
    """One left join from session grain: a session without tags keeps its own keys, a session with tags
    is repeated per tag, which is the rule and not an accident of the join."""
    if tags is None:
        spread = parts
    else:
        tag = tags.select(F.col("session_id").alias("_tag_session"), F.col("repo_key").alias("_tag_key"), F.col("name").alias("_tag_name"))
        joined = parts.join(tag, parts["session_id"] == tag["_tag_session"], "left")
        tagged = F.col("_tag_key").isNotNull()
        spread = joined.select(
            *grain,
            F.when(tagged, F.col("_tag_key")).otherwise(F.col("repo_key")).alias("repo_key"),
            F.when(tagged, F.col("_tag_name")).otherwise(F.col("slug")).alias("slug"),
            F.when(tagged, F.col("_tag_name")).otherwise(F.col("repo_name")).alias("repo_name"),
            "cost_micro",
            "unpriced_events",
            "event_count",
        )
    return spread.groupBy(*grain, "repo_key", "slug", "repo_name").agg(*merged_sums())


def merge_repositories(rows: DataFrame, grain: list[str]) -> DataFrame:
    """One row per repository under a unique label; everything without a repository is one named row."""
    labelled = with_repo_label(rows)
    merged = labelled.groupBy("member", *grain, "label", "repo_key").agg(*merged_sums())
    # the repository-less folders are few rows by now; they fold into one row per grain
    folded = merged.groupBy(
        *grain, F.when(F.col("repo_key").isNotNull(), F.col("label")).otherwise(F.lit(UNATTRIBUTED)).alias("_label"), "repo_key"
    ).agg(*merged_sums())
    return number_twins(folded.withColumnRenamed("_label", "label"))


def number_twins(rows: DataFrame) -> DataFrame:
    """Different repositories with one label become `label`, `label (2)`, … in key order."""
    nth = F.dense_rank().over(W.partitionBy("label", F.col("repo_key").isNull()).orderBy("repo_key"))
    return rows.withColumn("_nth", nth).withColumn(
        "label",
        F.when((F.col("_nth") > 1) & F.col("repo_key").isNotNull(), F.concat("label", F.lit(" ("), F.col("_nth"), F.lit(")"))).otherwise(
            F.col("label")
        ),
    ).drop("_nth")


def repo_labels(events: DataFrame, start: Instant, end: Instant, tags: DataFrame | None = None) -> DataFrame:
    """(repo_key, label, event_count): the unique label each repository carries in the window."""
    return labels_of_rows(repo_rows(in_range(events, start, end), tags))


def labels_of_rows(rows: DataFrame) -> DataFrame:
    return merge_repositories(rows, []).filter(F.col("repo_key").isNotNull()).select("repo_key", "label", "event_count")


def dimension_totals(rows: DataFrame, collation: str | None = None) -> DataFrame:
    """Totals per label, dearest first, then by label: byte order, or a collation such as `UNICODE` for people to read."""
    by_name = F.collate("label", collation) if collation else F.col("label")
    return rows.groupBy("label").agg(*merged_sums()).orderBy(F.desc("cost_micro"), by_name.asc())


def rank_labels(totals: DataFrame) -> DataFrame:
    """Adds the zero-based place of each label, dearest first, then by label.

    Ranked inside ranges of that order, so labels never meet in one task whatever their costs; one row per range is
    chained afterwards. The ranges are written out because both steps must see the same ones.
    """
    order = [F.desc("cost_micro"), F.asc("label")]
    ranges = materialize(totals.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "totals")
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_range", (F.sum("_size").over(W.orderBy("_range")) - F.col("_size")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    ranked = ranges.withColumn("_inner", inside).join(offsets, "_range")
    return ranked.select(*totals.columns, (F.col("_before") + F.col("_inner")).cast("bigint").alias("place"))


def dimension_domain(
    events: DataFrame,
    dimension: Dimension,
    start: Instant,
    end: Instant,
    tags: DataFrame | None = None,
) -> DataFrame:
    """(place, label) over a fixed lookback, so a label's colour does not depend on the chosen window."""
    window = in_range(events, start, end)
    if dimension is Dimension.REPO:
        totals = merge_repositories(repo_rows(window, tags), [])
    elif dimension is Dimension.PROJECT:
        totals = merge_projects(project_rows(window, []), [])
    else:
        totals = window.groupBy(dimension_value(dimension).alias("label")).agg(*spend_sums())
    summed = totals.groupBy("label").agg(*merged_sums())
    return rank_labels(summed).select("place", "label")


def top_labels(rows: DataFrame, count: int = TOP_SERIES) -> DataFrame:
    """The dearest labels of the window with their zero-based place; at most `count` rows."""
    top = rows.groupBy("label").agg(F.sum("cost_micro").alias("_total")).orderBy(F.desc("_total"), F.asc("label")).limit(count)
    return top.select(
        "label", (F.row_number().over(W.orderBy(F.desc("_total"), F.asc("label"))) - 1).cast("bigint").alias("place")
    )


def series_slots(shown: DataFrame, domain: DataFrame, slots: int = TOP_SERIES) -> DataFrame:
    """(label, place, slot): a label keeps its domain place as its slot when that is free, else the lowest slot left.

    Both inputs are cut to at most `slots` rows before they meet, so nothing here grows with the data.
    """
    placed = shown.filter(F.col("place") < slots).join(
        domain.filter(F.col("place") < slots).select(F.col("label").alias("_label"), F.col("place").alias("slot")),
        F.col("label") == F.col("_label"),
        "left",
    ).drop("_label")
    gathered = placed.agg(F.array_sort(F.collect_list(F.struct("place", "label", "slot"))).alias("_all"))
    claimed = F.transform("_all", lambda s: s["slot"])
    free = F.filter(F.sequence(F.lit(0), F.lit(slots - 1)), lambda n: ~F.array_contains(F.filter(claimed, lambda s: s.isNotNull()), n.cast("bigint")))
    waiting = F.transform(F.filter("_all", lambda s: s["slot"].isNull()), lambda s: s["label"])
    resolved = F.transform(
        "_all",
        lambda s: F.struct(
            s["label"].alias("label"),
            s["place"].alias("place"),
            F.coalesce(s["slot"], F.get(free, (F.array_position(waiting, s["label"]) - 1).cast("int")).cast("bigint")).alias("slot"),
        ),
    )
    return gathered.select(F.inline(resolved))


def label_series(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Marks each row with its series. The flag keeps a label that happens to read `Other` apart."""
    # `top` holds at most a handful of rows by construction, so broadcasting it is safe
    named = F.broadcast(top.select(F.col("label").alias("_top")))
    joined = rows.join(named, F.col("label") == F.col("_top"), "left")
    return joined.withColumn("is_other", F.col("_top").isNull()).withColumn(
        "series", F.coalesce("_top", F.lit(OTHER))
    ).drop("_top")


def bucket_rows(rows: DataFrame, first_day: Column | dt.date, last_day: Column | dt.date) -> DataFrame:
    """Re-keys `day` to the label of its bar; done before any roll-up so ratios come from sums.

    The label is made non-nullable: a later join on it would otherwise push "label is not NULL" through
    the roll-ups and work the label out once per event.
    """
    label = bars.day_bar_label(F.col("day").cast("date"), first_day, last_day)
    return rows.withColumn("day", F.coalesce(label, F.lit("")))


def series_per_bar(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Long form of the chart: one row per bar and series that has events."""
    return label_series(rows, top).groupBy("day", "series", "is_other").agg(*merged_sums())


def pivot_series(rows: DataFrame, top: DataFrame, labels: list[str]) -> DataFrame:
    """Wide form for a caller who already knows the shown labels: one column per label plus `Other`."""
    long = label_series(rows, top)
    columns = [F.sum(F.when(~F.col("is_other") & (F.col("label") == name), F.col("cost_micro"))).alias(name) for name in labels]
    other = F.sum(F.when(F.col("is_other"), F.col("cost_micro"))).alias(OTHER)
    return long.groupBy("day").agg(*columns, other, F.sum("unpriced_events").alias("unpriced_events"), F.sum("event_count").alias("event_count"))


def series_chart(rows: DataFrame, first_day: dt.date, last_day: dt.date) -> DataFrame:
    """Top labels and `Other` per bar. The day rows are read twice, so they are written out once first."""
    kept = materialize(rows, "daily")
    return series_per_bar(bucket_rows(kept, first_day, last_day), top_labels(kept))


def unpriced_days(rows: DataFrame) -> DataFrame:
    """One row: how many days (or bars) hold unpriced events, how many events, and the sentence about it."""
    per_day = rows.groupBy("day").agg(F.sum("unpriced_events").alias("unpriced_events")).filter("unpriced_events > 0")
    counted = per_day.agg(
        F.count(F.lit(1)).alias("day_count"),
        F.coalesce(F.sum("unpriced_events"), F.lit(0)).alias("event_count"),
        F.array_join(F.array_sort(F.collect_list("day")), ",").alias("days"),
    )
    return counted.withColumn("notice", money.unpriced_notice(F.col("day_count"), F.col("event_count")))
