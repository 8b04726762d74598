"""Kept sums against recomputation from the table."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at, dicts, event, frame
from spendmart.operators import sessions, splits
from spendmart.schemas import Dimension
from spendmart.sources import marts
from spendmart.sources.event_table import EventTable


def sends(rng, count):
    """Random rows, many of them re-sent with other settings; a re-send moves its row to another project or makes it unpriced."""
    return [
        event(
            rng.randint(0, 25), session_id=f"s{rng.randint(0, 3)}", machine_id=rng.choice(["a", "b"]), ts=at(f"2026-08-0{rng.randint(1, 4)}T1{rng.randint(0, 9)}:00:00"),
            cost_micro=Decimal(rng.randint(0, 99)), project_slug=rng.choice(["p/q", "r/s", None]), priced=rng.random() < 0.7, repo_key=rng.choice([None, "k"]), model=rng.choice(["claude-opus-5", "x"]),
        )
        for _ in range(count)
    ]


def numbered(spark, rows):
    return frame(spark, *rows).coalesce(1).withColumn("n", F.monotonically_increasing_id())


def test_marts_equal_recomputation_after_random_resends(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(marts, "RUNS", 2)
    table = EventTable(spark, str(tmp_path / "events"), changes=True)
    totals, cube = marts.session_totals(table), marts.daily_cube(table)
    with pytest.raises(FileNotFoundError):
        totals.totals()
    for batch in range(5):
        table.merge(numbered(spark, sends(rng, 30)), F.col("n"), job="j", batch=batch)
        if batch != 2:  # one refresh takes in two commits
            assert totals.refresh() == batch + 1
    assert not table.merge(numbered(spark, sends(rng, 5)), F.col("n"), job="j", batch=4) and totals.refresh() == 5
    events = table.events()
    want = events.groupBy("session_id").agg(*splits.spend_sums())
    assert dicts(totals.totals(), "session_id") == dicts(want, "session_id")
    assert len(totals._runs()) == 2  # runs were merged on the way

    cube.refresh()
    lo, hi = "2026-07-31 17:00:00", "2026-08-04 16:59:59.999"  # whole days in the zone of the cube
    for dimension in (Dimension.MACHINE, Dimension.MODEL):
        got = marts.cost_per_whole_day(cube.totals(), dimension, "2026-08-01", "2026-08-04")
        assert dicts(got, "day", "label") == dicts(splits.cost_per_day(events, dimension, lo, hi), "day", "label")
    with pytest.raises(ValueError):
        marts.cost_per_whole_day(cube.totals(), Dimension.REPO, "2026-08-01", "2026-08-04")

    # a page with kept totals: the same rows, without reading the table for them
    page = sessions.page_of(sessions.group_sessions(events), sessions.SessionSort.COST)
    kept = sessions.with_lifetime(page, events, totals.totals())
    assert dicts(kept, "session_id") == dicts(sessions.with_lifetime(page, events), "session_id")
    assert not any("/data/commit=" in f for f in kept.inputFiles())


def test_a_merge_that_was_cut_off_counts_nowhere(spark, tmp_path, monkeypatch):
    table = EventTable(spark, str(tmp_path / "events"), changes=True)
    totals = marts.session_totals(table)
    table.merge(numbered(spark, [event(1)]), F.col("n"))

    def cut_off(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_publish", cut_off)
        with pytest.raises(RuntimeError):
            table.merge(numbered(spark, [event(2)]), F.col("n"))
    totals.refresh()
    assert [(r.session_id, r.event_count) for r in totals.totals().collect()] == [("s1", 1)]
