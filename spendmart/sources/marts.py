"""Sums kept next to the event table: every merge adds what it changed, signed.

A merge of an `EventTable(..., changes=True)` records its rows as they were (sign -1) and are (sign +1). Summed by any
keys of an event, these differences add up to the sums of the table, however often rows were re-sent and whatever moved
from one key to another. So a mart takes in each commit once, without reading the table, and a page or a chart reads the
mart instead of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.functions import clock, money
from spendmart.operators.splits import dimension_value
from spendmart.schemas import DASHBOARD_ZONE, Dimension
from spendmart.sources.event_table import EventTable

MEASURES = ["cost_micro", "unpriced_events", "event_count"]
RUNS = 8  # differences that are read together before they become one


class Mart:
    """cost_micro (gated), unpriced_events and event_count by `keys`, as of the last `refresh`.

    Stored as runs, each the differences of a range of commits: `from=a/to=b`. Runs are written once. A refresh adds
    one run; when RUNS of them have gathered, the new run replaces all of them. A reader takes, from the first commit
    on, the longest run that begins where the last one ended, so an unfinished or replaced run is never counted.
    """

    def __init__(self, table: EventTable, name: str, keys: dict[str, Callable[[], Column]]):
        self.table, self.keys = table, keys
        self.spark, self.path = table.spark, f"{table.path}/marts/{name}"

    def _runs(self) -> list[tuple[int, int]]:
        try:
            files = self.spark.read.parquet(self.path).inputFiles()
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise
        place = lambda f, name: int(f.split(f"/{name}=")[1].split("/")[0])
        found, chain, at = {(place(f, "from"), place(f, "to")) for f in files}, [], 1
        while ends := [b for a, b in found if a == at]:
            chain.append((at, max(ends)))
            at = max(ends) + 1
        return chain

    def _stored(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/from={a}/to={b}" for a, b in runs])

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in MEASURES])

    def refresh(self) -> int:
        """Takes in the commits since the last refresh; the version the mart now stands for."""
        runs = self._runs()
        done = runs[-1][1] if runs else 0
        fresh = [(v, c) for v, c in self.table.commits() if v > done]
        if not fresh:
            return done
        paths = [f"{self.table.path}/changes/commit={c}" for _, c in fresh]
        sign = F.col("sign")
        signed = self.spark.read.parquet(*paths).select(
            *[build().alias(name) for name, build in self.keys.items()],
            (money.gated(F.col("cost_micro"), F.col("priced")) * sign).alias("cost_micro"),
            (money.unpriced(F.col("priced")) * sign).alias("unpriced_events"),
            sign.cast("bigint").alias("event_count"),
        )
        rows, first = self._summed(signed), done + 1
        if len(runs) >= RUNS:
            rows, first = self._summed(rows.select(*self.keys, *MEASURES).unionByName(self._stored(runs).select(*self.keys, *MEASURES))), 1
        # differences that cancel out need no row
        rows = rows.filter(" OR ".join(f"{c} <> 0" for c in MEASURES))
        rows.write.parquet(f"{self.path}/from={first}/to={fresh[-1][0]}")
        return fresh[-1][0]

    def totals(self) -> DataFrame:
        """The sums of all events by the mart's keys; keys that no event has any more are gone."""
        runs = self._runs()
        if not runs:
            raise FileNotFoundError(f"refresh {self.path} first")
        return self._summed(self._stored(runs)).filter("event_count <> 0")


def session_totals(table: EventTable) -> Mart:
    """What each session cost over all time."""
    return Mart(table, "sessions", {"session_id": lambda: F.col("session_id")})


def daily_cube(table: EventTable, zone: str = DASHBOARD_ZONE) -> Mart:
    """By day in a zone and all split dimensions, enough for any split over whole days."""
    keys = {"day": lambda: clock.day_key(F.col("ts"), zone)}
    for dimension in (Dimension.MACHINE, Dimension.MODEL, Dimension.PROJECT):
        keys[dimension.value] = lambda d=dimension: dimension_value(d)
    return Mart(table, f"daily-{zone.replace('/', '-')}", keys | {"repo_key": lambda: F.col("repo_key")})


def cost_per_whole_day(cube: DataFrame, dimension: Dimension, first_day: str, last_day: str) -> DataFrame:
    """(day, label, cost_micro, unpriced_events, event_count) of machines or models, from the cube, for whole days."""
    if dimension not in (Dimension.MACHINE, Dimension.MODEL):
        raise ValueError("projects and repositories are labelled from events")
    window = cube.filter(F.col("day").between(first_day, last_day))
    return window.groupBy("day", F.col(dimension.value).alias("label")).agg(*[F.sum(c).alias(c) for c in MEASURES])
