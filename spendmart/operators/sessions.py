"""Session lists, drill-downs, per-session breakdowns and turn timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.functions import bars, clock, money
from spendmart.operators.filters import Instant, in_range
from spendmart.operators.ordered import blocked_rank
from spendmart.operators.pricing import carry_split
from spendmart.operators.splits import dimension_value, labels_of_rows, merged_sums, repo_labels, spend_sums, spread_tags, with_repo_label
from spendmart.schemas import MONEY, UNATTRIBUTED, Dimension, SessionSort
from spendmart.session import materialize

PAGE_SIZE = 25
TURN_ORDER = ["ts", "request_id", "message_id"]


def session_partials(events: DataFrame, *keys: str) -> DataFrame:
    """Mergeable measures per session and extra keys: earliest owner, span, spend, models, newest title.

    Every aggregate combines before the shuffle, so a session holding much of the data stays cheap.
    """
    return events.groupBy("session_id", *keys).agg(
        F.min(F.struct(*TURN_ORDER, "project_slug", "machine_id")).alias("_owner"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        *spend_sums(),
        F.collect_set(dimension_value(Dimension.MODEL)).alias("models"),
        F.max(F.when(F.col("session_title").isNotNull(), F.struct("ts", "session_title"))).alias("_title"),
        F.max("repo_name").alias("repo_name"),
    )


def merge_partials(partials: DataFrame, *keys: str) -> DataFrame:
    """Partials of one session (and keys) in one row.

    Models are exploded and grouped first, so what is gathered per session is a set of models, however many
    folders it touched; the measures ride on the first model of each partial.
    """
    spread = partials.select("*", F.posexplode_outer("models").alias("_nth", "model"))
    leading = F.coalesce(F.col("_nth"), F.lit(0)) == 0
    sums = ("cost_micro", "unpriced_events", "event_count")
    extremes = lambda: [
        F.min("_owner").alias("_owner"),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
        F.max("_title").alias("_title"),
    ]
    per_model = spread.groupBy("session_id", *keys, "model").agg(*extremes(), *[F.sum(F.when(leading, F.col(c))).alias(c) for c in sums])
    return per_model.groupBy("session_id", *keys).agg(*extremes(), *merged_sums(), F.collect_set("model").alias("models"))


def finish_sessions(partials: DataFrame, *keys: str) -> DataFrame:
    return partials.select(
        "session_id",
        *keys,
        F.coalesce("_owner.project_slug", F.lit(UNATTRIBUTED)).alias("project_slug"),
        F.coalesce("_owner.machine_id", F.lit(UNATTRIBUTED)).alias("machine_id"),
        "started_at",
        "ended_at",
        "cost_micro",
        "unpriced_events",
        "event_count",
        F.array_sort("models").alias("models"),
        F.col("_title.session_title").alias("session_title"),
    )


def group_sessions(events: DataFrame, *keys: str) -> DataFrame:
    """One row per session (and extra keys)."""
    return finish_sessions(session_partials(events, *keys), *keys)


def page_of(sessions: DataFrame, sort: SessionSort, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """One page, ordered descending with the session id breaking ties."""
    ordered = sessions.orderBy(F.desc(sort.value), F.asc("session_id"))
    return (ordered.offset(page * size) if page else ordered).limit(size)


class SessionPages:
    """Pages of one listing, read by position: rows dealt once to ranges of the page order, with the rows of each range.

    The order breaks ties by session id, so ranges are even whatever the values. A page opens the ranges it overlaps and sorts
    those alone. `ranges` numbers are held on the driver.
    """

    def __init__(self, sessions: DataFrame, sort: SessionSort, ranges: int | None = None) -> None:
        spark = sessions.sparkSession
        self.order = [F.desc(sort.value), F.asc("session_id")]
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = sessions.repartitionByRange(ranges, *self.order).withColumn("_range", F.spark_partition_id())
        self.rows = materialize(dealt, "pages", partition_by="_range")
        counted = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.sizes = sorted(counted.items())

    def count(self) -> int:
        return sum(n for _, n in self.sizes)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """The same rows as `page_of` for that page; none beyond the last."""
        first, before, held, skipped = number * size, 0, [], 0
        for part, n in self.sizes:
            if before + n <= first:
                skipped = before + n
            elif before < first + size:
                held.append(part)
            before += n
        chosen = self.rows.filter(F.col("_range").isin(held)) if held else self.rows.limit(0)
        return chosen.drop("_range").orderBy(*self.order).offset(first - skipped).limit(size)


def page_index(raw: str | None) -> int:
    """Zero-based page of a one-based request; anything unusable is the first page."""
    try:
        number = float(raw) if raw is not None and raw.strip() else 0.0
    except ValueError:
        return 0
    return int(number) - 1 if number.is_integer() and number >= 1 else 0


def with_lifetime(page: DataFrame, events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Adds what each listed session cost over all time. The page is written out once, so its sessions are not
    grouped again and the optimiser knows its size; whether to broadcast it is left to its check.

    `totals`: the kept sums of sessions (`marts.session_totals(table).totals()`); with them no event is read."""
    page = materialize(page, "page")
    ids = page.select(F.col("session_id").alias("_id"))
    if totals is not None:
        kept = totals.select(F.col("session_id").alias("_id"), F.col("cost_micro").alias("total_micro"), F.col("unpriced_events").alias("total_unpriced"))
        return page.join(kept.join(ids, "_id", "left_semi"), F.col("session_id") == F.col("_id"), "left").drop("_id")
    totals = (
        events.join(ids, F.col("session_id") == F.col("_id"), "left_semi")
        .groupBy(F.col("session_id").alias("_id"))
        .agg(
            F.sum(money.gated(F.col("cost_micro"), F.col("priced"))).alias("total_micro"),
            F.sum(money.unpriced(F.col("priced"))).alias("total_unpriced"),
        )
    )
    return page.join(totals, F.col("session_id") == F.col("_id"), "left").drop("_id")


def list_sessions(
    events: DataFrame, start: Instant, end: Instant, sort: SessionSort = SessionSort.COST, page: int = 0, size: int = PAGE_SIZE,
    totals: DataFrame | None = None,
) -> DataFrame:
    """One page of the window's sessions with their lifetime totals, kept ones where given. Many pages: `session_pages`."""
    return with_lifetime(page_of(group_sessions(in_range(events, start, end)), sort, page, size), events, totals)


def session_pages(events: DataFrame, start: Instant, end: Instant, sort: SessionSort = SessionSort.COST, ranges: int | None = None) -> SessionPages:
    """The window's sessions grouped and ranged once, for reading any of their pages."""
    return SessionPages(group_sessions(in_range(events, start, end)), sort, ranges)


def count_sessions(events: DataFrame, start: Instant, end: Instant) -> DataFrame:
    """One row: how many sessions the window holds."""
    return in_range(events, start, end).agg(F.count_distinct("session_id").alias("session_count"))


def header_of(sessions: DataFrame, *keys: str) -> DataFrame:
    """Totals of the listed sessions, so a header can never disagree with its rows."""
    return sessions.groupBy(*keys).agg(
        F.sum("cost_micro").alias("cost_micro"),
        F.sum("unpriced_events").alias("unpriced_events"),
        F.sum("event_count").alias("event_count"),
        F.count(F.lit(1)).alias("session_count"),
    )


def sessions_by_label(
    events: DataFrame, dimension: Dimension, start: Instant, end: Instant, tags: DataFrame | None = None
) -> DataFrame:
    """The sessions behind every label of a split: one row per (label, session).

    Uses the same label relation as the split itself, so a header and the row it was opened from agree.
    """
    window = in_range(events, start, end)
    if dimension is Dimension.REPO:
        return _repo_sessions(_parts(window), tags)
    if dimension is Dimension.PROJECT:
        return _project_sessions(_parts(window))
    return group_sessions(window.withColumn("label", dimension_value(dimension)), "label")


def _parts(window: DataFrame) -> DataFrame:
    """Each session's measures per folder and repository, written out once: labels and sessions both come from them."""
    return materialize(session_partials(window, "repo_key", "project_slug"), "parts").withColumn(
        "slug", dimension_value(Dimension.PROJECT)
    )


def sessions_of_value(
    events: DataFrame, dimension: Dimension, value: str, start: Instant, end: Instant, tags: DataFrame | None = None
) -> DataFrame:
    """The sessions behind one label. Machine and model values are filtered before anything is grouped."""
    if dimension in (Dimension.MACHINE, Dimension.MODEL):
        chosen = in_range(events, start, end).filter(dimension_value(dimension) == value)
        return group_sessions(chosen)
    if dimension is Dimension.REPO and value != UNATTRIBUTED:
        return group_sessions(_repo_events(in_range(events, start, end), value, repo_labels(events, start, end, tags), tags))
    return sessions_by_label(events, dimension, start, end, tags).filter(F.col("label") == value).drop("label")


def drill_down(
    events: DataFrame,
    dimension: Dimension,
    value: str,
    start: Instant,
    end: Instant,
    tags: DataFrame | None = None,
    sort: SessionSort = SessionSort.COST,
    page: int = 0,
    size: int = PAGE_SIZE,
) -> tuple[DataFrame, DataFrame]:
    """(header, page) of one label. Both read one grouped set of sessions, written out once; the page carries lifetime totals."""
    sessions = materialize(sessions_of_value(events, dimension, value, start, end, tags), "drill")
    return header_of(sessions), with_lifetime(page_of(sessions, sort, page, size), events)


def _repo_events(window: DataFrame, value: str, labels: DataFrame, tags: DataFrame | None) -> DataFrame:
    """Events that count under one repository's label: whole tagged sessions, and what untagged ones did in that repository.

    The label is resolved to its key first, from sums alone; only the events behind it are grouped into sessions.
    """
    key = materialize(labels.filter(F.col("label") == value).select(F.col("repo_key").alias("_key")), "label-key")
    if tags is None:
        return window.join(key, F.col("repo_key") == F.col("_key"), "left_semi")
    tagged = tags.select(F.col("session_id").alias("_sid"), F.col("repo_key").alias("_tag")).join(key, F.col("_tag") == F.col("_key"), "left")
    whole = tagged.groupBy("_sid").agg(F.bool_or(F.col("_key").isNotNull()).alias("_whole"))
    placed = window.join(whole, F.col("session_id") == F.col("_sid"), "left").join(key, F.col("repo_key") == F.col("_key"), "left")
    return placed.filter("coalesce(_whole, _key IS NOT NULL)").drop("_sid", "_whole", "_key")


def _project_sessions(parts: DataFrame) -> DataFrame:
    rows = parts.filter(F.col("repo_key").isNotNull()).groupBy("slug", "repo_key").agg(*merged_sums(), F.max("repo_name").alias("repo_name"))
    labels = with_repo_label(rows).groupBy(F.col("repo_key").alias("_key")).agg(F.min("label").alias("_label"))
    joined = parts.join(labels, F.col("repo_key") == F.col("_key"), "left").withColumn("label", F.coalesce("_label", "slug"))
    return finish_sessions(merge_partials(joined, "label"), "label")


def _repo_sessions(parts: DataFrame, tags: DataFrame | None) -> DataFrame:
    """A tagged session counts whole under each of its tags, an untagged one only its parts with that repository.

    Labels join before the parts are merged, so a filter on the label reaches them and only that label's sessions meet.
    """
    labels = labels_of_rows(spread_tags(parts, tags))
    if tags is not None:
        tag = tags.select(F.col("session_id").alias("_sid"), F.col("repo_key").alias("_tag_key"))
        parts = parts.join(tag, parts["session_id"] == tag["_sid"], "left").withColumn(
            "repo_key", F.coalesce("_tag_key", "repo_key")
        )
    named = labels.select(F.col("repo_key").alias("_key"), F.col("label").alias("_label"))
    labelled = parts.join(named, F.col("repo_key") == F.col("_key"), "left").withColumn(
        "label", F.coalesce("_label", F.lit(UNATTRIBUTED))
    )
    return finish_sessions(merge_partials(labelled, "label", "repo_key"), "label")


def session_meta(events: DataFrame) -> DataFrame:
    """One row per session: owner and account of its earliest event, span and spend."""
    grouped = events.groupBy("session_id").agg(
        F.min(F.struct(*TURN_ORDER, "project_slug", "machine_id", "account_uuid", "org_uuid")).alias("_owner"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        *spend_sums(),
    )
    return grouped.select(
        "session_id", "_owner.project_slug", "_owner.machine_id", "_owner.account_uuid", "_owner.org_uuid",
        "started_at", "ended_at", "cost_micro", "unpriced_events", "event_count",
    )


def session_models(events: DataFrame) -> DataFrame:
    """One row per session and model."""
    paid = money.gated(F.col("cost_micro"), F.col("priced"))
    lost = money.unpriced(F.col("priced"))
    zero = F.lit(0)
    return events.groupBy("session_id", dimension_value(Dimension.MODEL).alias("model")).agg(
        *spend_sums(),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens")],
        F.coalesce(F.sum(F.when(F.col("is_subagent"), paid)), zero).alias("subagent_micro"),
        F.coalesce(F.sum(F.when(F.col("is_subagent"), lost)), zero).alias("subagent_unpriced"),
    )


def session_turns(events: DataFrame, prices: DataFrame) -> DataFrame:
    """One narrow row per event with its cost split into carry and new. Order by TURN_ORDER to read it oldest first."""
    narrow = events.select(
        "session_id", *TURN_ORDER, "model", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens",
        "cost_micro", "priced", "is_subagent",
    )
    return carry_split(narrow, prices).select(
        "session_id", *TURN_ORDER, "is_subagent", "priced",
        money.gated(F.col("cost_micro"), F.col("priced")).alias("cost_micro"), "carry_micro", "new_micro",
    )


def turn_timeline(turns: DataFrame) -> DataFrame:
    """Each session's turns in at most twenty bars of equal length, main and subagent series on the same bars.

    Positions come from the blocked rank (block: the minute), so one huge session spreads over many tasks.
    A bar always holds a turn, so the dense grid needs no join: each bar yields both series.
    """
    ranked = blocked_rank(turns, ["session_id"], [F.col(c) for c in TURN_ORDER], clock.minute_of(F.col("ts")), "position", "turn_count")
    barred = ranked.withColumn("bar", bars.bar_of(F.col("position"), F.col("turn_count")))

    def series(flag: bool):
        mine = F.coalesce(F.col("is_subagent"), F.lit(False)) == flag
        zero = F.lit(0).cast(MONEY)
        return [
            F.sum(F.when(mine, F.col("carry_micro")).otherwise(zero)).alias("carry_micro"),
            F.sum(F.when(mine, F.col("new_micro")).otherwise(zero)).alias("new_micro"),
            F.sum(F.when(mine, money.unpriced(F.col("priced"))).otherwise(0)).alias("unpriced_events"),
        ]

    per_bar = barred.groupBy("session_id", "bar").agg(
        F.min("position").alias("_low"),
        F.max("position").alias("_high"),
        *[c.alias(f"main_{n}") for c, n in zip(series(False), ("carry", "new", "unpriced"))],
        *[c.alias(f"sub_{n}") for c, n in zip(series(True), ("carry", "new", "unpriced"))],
    )
    both = F.array(
        *[
            F.struct(
                F.lit(name).alias("series"),
                F.col(f"{prefix}_carry").alias("carry_micro"),
                F.col(f"{prefix}_new").alias("new_micro"),
                F.col(f"{prefix}_unpriced").alias("unpriced_events"),
            )
            for name, prefix in (("main", "main"), ("subagent", "sub"))
        ]
    )
    label = bars.turn_label(F.col("_low"), F.col("_high"))
    return per_bar.select("session_id", "bar", label.alias("label"), F.inline(both))


def timeline_summary(timeline: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per session: what the chart adds up to, the note when that differs from the bill, and empty flags."""
    moved = (F.col("carry_micro") != 0) | (F.col("new_micro") != 0)
    summed = timeline.groupBy("session_id").agg(
        F.sum(F.col("carry_micro") + F.col("new_micro")).alias("chart_micro"),
        F.bool_or(moved & (F.col("series") == "main")).alias("_main"),
        F.bool_or(moved & (F.col("series") == "subagent")).alias("_sub"),
    )
    joined = summed.join(meta.select("session_id", "cost_micro", "event_count", "unpriced_events"), "session_id")
    return joined.select(
        "session_id",
        "chart_micro",
        "cost_micro",
        money.divergence_note(F.col("chart_micro"), F.col("cost_micro")).alias("note"),
        (~F.col("_main") & F.col("_sub")).alias("only_subagents"),
        F.when(~F.col("_main") & ~F.col("_sub"), money.empty_timeline_text(F.col("event_count"), F.col("unpriced_events"))).alias("empty_text"),
    )
