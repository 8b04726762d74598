from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at, dicts, event, frame
from spendmart.operators import efficiency, sessions, splits
from spendmart.operators.pricing import price_book
from spendmart.schemas import Dimension, SessionSort

FROM, TO = "2026-07-01 00:00:00", "2026-09-01 00:00:00"


def by_label(rows):
    return {(r["day"], r["label"]): (int(r["cost_micro"]), r["unpriced_events"], r["event_count"]) for r in rows.collect()}


def test_range_is_inclusive_and_cost_is_gated(spark):
    rows = frame(
        spark, event(1, ts=at("2026-07-01T00:00:00")), event(2, ts=at("2026-09-01T00:00:00"), priced=False, model=None), event(3, ts=at("2026-09-01T00:00:00.001"))
    )
    got = by_label(splits.cost_per_day(rows, Dimension.MODEL, FROM, TO))
    assert got == {("2026-07-01", "claude-opus-5"): (250000, 0, 1), ("2026-09-01", "(unattributed)"): (0, 1, 1)}


def test_one_label_per_repository_for_the_whole_window(spark):
    # a worktree holds most events, git's own name still wins; without one the busiest folder names the repository
    rows = frame(
        spark,
        *[event(n, repo_key="k1", project_slug="team/app-ticket", ts=at("2026-08-02T10:00:00")) for n in range(3)],
        event(10, repo_key="k1", project_slug="team/app", repo_name="team/app"),
        event(11, repo_key="k2", project_slug="b/long"),
        event(12, repo_key="k2", project_slug="b/x"),
        event(13, project_slug="team/app"),
    )
    got = splits.cost_per_day(rows, Dimension.PROJECT, FROM, TO)
    assert sorted((r["day"], r["label"], r["event_count"]) for r in got.collect()) == [
        ("2026-08-01", "b/x", 2), ("2026-08-01", "team/app", 1), ("2026-08-01", "team/app", 1), ("2026-08-02", "team/app", 3),
    ]


def tags(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, repo_key string, name string")


def repo_fixture(spark):
    rows = frame(
        spark,
        event(1, session_id="two", repo_key="k9"),
        event(2, session_id="two"),
        event(3, session_id="plain", repo_key="k3", repo_name="a/lib"),
        event(4, session_id="plain"),
        event(5, session_id="twin", priced=False),
    )
    return rows, tags(spark, ("two", "k1", "a/app"), ("two", "k2", "a/lib"), ("twin", "k4", "a/lib"))


def test_tagged_sessions_count_whole_under_each_tag_and_twins_are_numbered(spark):
    rows, tagged = repo_fixture(spark)
    got = by_label(splits.cost_per_day(rows, Dimension.REPO, FROM, TO, tagged))
    day = "2026-08-01"
    assert got == {
        (day, "a/app"): (500000, 0, 2), (day, "a/lib"): (500000, 0, 2), (day, "a/lib (2)"): (250000, 0, 1),
        (day, "a/lib (3)"): (0, 1, 1), (day, "(unattributed)"): (250000, 0, 1),
    }


@pytest.mark.parametrize("dimension", list(Dimension))
def test_every_row_equals_its_drill_down(spark, dimension):
    rows, tagged = repo_fixture(spark)
    split = splits.dimension_totals(splits.cost_per_day(rows, dimension, FROM, TO, tagged if dimension is Dimension.REPO else None))
    header = sessions.header_of(sessions.sessions_by_label(rows, dimension, FROM, TO, tagged if dimension is Dimension.REPO else None), "label")
    columns = ["label", "cost_micro", "unpriced_events", "event_count"]
    assert dicts(split.select(*columns), "label") == dicts(header.select(*columns), "label")
    for row in split.collect():
        one = sessions.sessions_of_value(rows, dimension, row["label"], FROM, TO, tagged if dimension is Dimension.REPO else None)
        assert sessions.header_of(one).first()["event_count"] == row["event_count"]


def test_other_series_does_not_swallow_a_label_called_other(spark):
    rows = spark.createDataFrame(
        [("d", "Other", Decimal(9), 0, 1)] + [("d", f"v{n}", Decimal(n), 0, 1) for n in range(1, 7)],
        "day string, label string, cost_micro decimal(18,6), unpriced_events bigint, event_count bigint",
    )
    long = splits.series_per_bar(rows, splits.top_labels(rows))
    got = {(r["series"], r["is_other"]): int(r["cost_micro"]) for r in long.collect()}
    assert got == {("Other", False): 9, ("v6", False): 6, ("v5", False): 5, ("v4", False): 4, ("v3", False): 3, ("Other", True): 3}


def test_slots_keep_domain_places_then_fill_gaps(spark):
    shown = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "label string, place bigint")
    domain = spark.createDataFrame([("c", 0), ("x", 1), ("y", 2), ("z", 3), ("b", 4), ("a", 5)], "label string, place bigint")
    assert {r["label"]: r["slot"] for r in splits.series_slots(shown, domain).collect()} == {"c": 0, "b": 4, "a": 1}


def test_ranked_labels_match_a_plain_sort(spark):
    rows = [(f"label{n:03d}", Decimal(n * n % 50 - 20)) for n in range(200)] + [("b", Decimal(0)), ("c", Decimal(0)), ("a", Decimal("-5"))]
    totals = spark.createDataFrame(rows, "label string, cost_micro decimal(28,6)")
    got = [r["label"] for r in splits.rank_labels(totals).orderBy("place").collect()]
    assert got == [label for label, cost in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_session_lists(spark):
    rows = frame(
        spark,
        event(1, session_id="a", ts=at("2026-06-30T00:00:00"), cost_micro=Decimal(5)),
        event(2, session_id="a", ts=at("2026-08-01T10:00:00"), session_title="old", project_slug=None),
        event(3, session_id="a", ts=at("2026-08-01T11:00:00"), session_title="new", model="claude-opus-5[1m]"),
        event(4, session_id="a", ts=at("2026-08-01T12:00:00"), model="claude-haiku-4-5-20251001", priced=False),
        event(5, session_id="b", ts=at("2026-08-01T12:00:00"), cost_micro=Decimal(250000)),
        event(6, session_id="c", ts=at("2026-08-01T09:00:00"), cost_micro=Decimal(250000)),
    )
    listed = [r.asDict() for r in sessions.list_sessions(rows, FROM, TO).collect()]
    listed.sort(key=lambda r: (-r["cost_micro"], r["session_id"]))
    first = listed[0]
    assert [r["session_id"] for r in listed] == ["a", "b", "c"]
    assert first["session_title"] == "new" and first["models"] == ["claude-haiku-4-5", "claude-opus-5"] and first["project_slug"] == "(unattributed)"
    assert (int(first["cost_micro"]), int(first["total_micro"]), first["unpriced_events"]) == (500000, 500005, 1)
    assert [r["session_id"] for r in sessions.page_of(sessions.group_sessions(rows), SessionSort.RECENT, 1, 1).collect()] == ["b"]
    assert [sessions.page_index(p) for p in (None, "1", "3", "0", "-2", "x", "1.5", "")] == [0, 0, 2, 0, 0, 0, 0, 0]


def test_timeline_positions_match_a_plain_order(spark):
    rows = frame(spark, *[event(n, ts=at(f"2026-08-01T{n % 24:02d}:{n % 60:02d}:00"), is_subagent=n % 3 == 0, cost_micro=Decimal(n)) for n in range(90)])
    bars = sessions.turn_timeline(sessions.session_turns(rows, price_book(spark))).orderBy("bar", "series").collect()
    assert len(bars) == 2 * 18 and [b["label"] for b in bars[:2]] == ["Turns 1–5"] * 2 and bars[-1]["label"] == "Turns 86–90"
    ordered = sorted(range(90), key=lambda n: (n % 24, n % 60, f"r{n}"))
    assert sum(int(b["new_micro"]) for b in bars if b["bar"] == 0) == sum(ordered[:5])


def test_share_is_unknown_when_subagents_ran_unpriced(spark):
    rows = spark.createDataFrame([(0, 0, 0), (10, 0, 3), (10, 0, 0), (8, 2, 1)], "c bigint, s bigint, n bigint")
    got = [r[0] for r in rows.select(efficiency.subagent_share(F.col("c"), F.col("s"), F.col("n"))).collect()]
    assert got == [None, None, 0.0, 0.25]


def test_month_to_date(spark):
    rows = frame(spark, event(1, ts=at("2026-08-01T10:00:00")), event(2, ts=at("2026-08-10T09:00:00"), priced=False), event(3, ts=at("2026-07-31T16:00:00")))
    got = efficiency.month_to_date(rows, "2026-08-10 10:00:00").first()
    assert got["month_usd"] == 0.25 and got["today_unpriced"] == 1 and got["projected_usd"] == 0.25 / 9 * 31
    assert efficiency.month_to_date(rows, "2026-08-01 10:00:00").first()["projected_usd"] is None


def test_dimension_names_are_closed():
    with pytest.raises(ValueError):
        Dimension.parse("constructor")
    assert SessionSort.parse("recent") is SessionSort.RECENT


def test_opaque_keys_never_leave_a_split(spark):
    rows, tagged = repo_fixture(spark)
    for dimension in Dimension:
        assert splits.cost_per_day(rows, dimension, FROM, TO, tagged).columns == ["day", "label", "cost_micro", "unpriced_events", "event_count"]


def test_pages_by_position_equal_the_sorted_list(spark):
    rows = spark.range(1003).select(F.format_string("s%04d", "id").alias("session_id"), (F.col("id") % 3).cast("decimal(38,6)").alias("cost_micro"))
    pages = sessions.SessionPages(rows, SessionSort.COST, ranges=9)
    assert pages.count() == 1003 and max(n for _, n in pages.sizes) < 400  # a third of all share each value
    for number in (0, 1, 20, 39, 40, 41):
        want = [r["session_id"] for r in sessions.page_of(rows, SessionSort.COST, number).collect()]
        assert [r["session_id"] for r in pages.page(number).collect()] == want, number
    plan = pages.page(20)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "_range#" in plan.split("PartitionFilters")[1]
    assert sessions.SessionPages(rows.limit(0), SessionSort.COST).page(0).count() == 0


def test_a_label_with_its_key_gives_the_sessions_of_the_whole_relation(spark):
    keyed = lambda n, s, k, **more: event(n, session_id=s, repo_key=k, repo_name=f"team/{k}" if k else None, **more)
    rows = frame(spark, keyed(1, "a", "k1"), keyed(2, "a", "k2"), keyed(3, "b", "k1"), keyed(4, "b", None), keyed(5, "c", None), keyed(6, "d", "k2"))
    tags = spark.createDataFrame([("b", "k2", "team/k2"), ("c", "k1", "team/k1"), ("c", "k2", "team/k2")], "session_id string, repo_key string, name string")
    window = ("2026-08-01 00:00:00", "2026-08-02 00:00:00")
    for known in (tags, None):
        every = dicts(sessions.sessions_by_label(rows, Dimension.REPO, *window, known), "label", "session_id")
        for label in ("team/k1", "team/k2", "none", "(unattributed)"):
            got = dicts(sessions.sessions_of_value(rows, Dimension.REPO, label, *window, known), "session_id")
            assert [(r["session_id"], r["event_count"]) for r in got] == [(r["session_id"], r["event_count"]) for r in every if r["label"] == label], label
