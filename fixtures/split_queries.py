"""Splits, labels, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import adapter as A
from fixtures.sql import TAG_CTE, query, usd
from spendmart.functions import money
from spendmart.operators import splits
from spendmart.schemas import Dimension


def _out(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, money.dollars(F.col("cost_micro")).alias("cost_usd"), "unpriced_events", "event_count")


def _day_rows(spark: SparkSession, sf: str, dimension: Dimension, window=(A.FROM, A.TO)) -> DataFrame:
    tags = A.session_tags(spark, sf) if dimension is Dimension.REPO else None
    return splits.cost_per_day(A.usage_events(spark, sf), dimension, *window, tags)


def cost_by(dimension: Dimension, window=(A.FROM, A.TO)):
    return lambda spark, sf: _out(_day_rows(spark, sf, dimension, window), "day", "label")


def repo_labels(spark, sf):
    labels = splits.repo_labels(A.usage_events(spark, sf), A.FROM, A.TO, A.session_tags(spark, sf))
    return labels.select("repo_key", "label")


def dimension_totals(spark, sf):
    return _out(splits.rank_labels(splits.dimension_totals(_day_rows(spark, sf, Dimension.PROJECT))), "place", "label")


def dimension_domain(spark, sf):
    return splits.dimension_domain(A.usage_events(spark, sf), Dimension.PROJECT, "2023-01-30 12:00:00", A.TO)


def series_slots(spark, sf):
    rows = _day_rows(spark, sf, Dimension.MODEL)
    domain = splits.dimension_domain(A.usage_events(spark, sf), Dimension.MODEL, A.FROM, "2024-01-10 00:00:00")
    return splits.series_slots(splits.top_labels(rows), domain)


def cost_series_top5(spark, sf):
    rows = _day_rows(spark, sf, Dimension.PROJECT)
    chart = splits.series_chart(rows, dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    return _out(chart, "day", "series", "is_other")


def unpriced_days(spark, sf):
    return splits.unpriced_days(_day_rows(spark, sf, Dimension.MACHINE))


QUERIES = {
    "cost_by_machine": cost_by(Dimension.MACHINE),
    "cost_by_model": cost_by(Dimension.MODEL),
    "cost_by_project": cost_by(Dimension.PROJECT),
    "cost_by_repo": cost_by(Dimension.REPO),
    "cost_by_machine_week": cost_by(Dimension.MACHINE, A.WEEK),
    "cost_by_model_week": cost_by(Dimension.MODEL, A.WEEK),
    "cost_by_project_week": cost_by(Dimension.PROJECT, A.WEEK),
    "cost_by_repo_week": cost_by(Dimension.REPO, A.WEEK),
    "repo_labels": repo_labels,
    "dimension_totals": dimension_totals,
    "dimension_domain": dimension_domain,
    "series_slots": series_slots,
    "cost_series_top5": cost_series_top5,
    "unpriced_days": unpriced_days,
}

MEASURES = f"{usd('sum(paid)')} AS cost_usd, cast(sum(unp) AS BIGINT) AS unpriced_events, count(*) AS event_count"
FOLDED = f"{usd('sum(micro)')} AS cost_usd, cast(sum(unpriced) AS BIGINT) AS unpriced_events, cast(sum(n) AS BIGINT) AS event_count"

# tiered name of each repository over the whole window
PROJECT_CTE = """
project_groups AS (
  SELECT day, slug, repo_key, max(repo_name) AS repo_name, sum(paid) AS micro, sum(unp) AS unpriced, count(*) AS n
  FROM usage GROUP BY day, slug, repo_key),
candidates AS (
  SELECT repo_key, 0 AS tier, repo_name AS name, sum(n) AS n FROM project_groups WHERE repo_key IS NOT NULL AND repo_name IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT repo_key, 1, slug, sum(n) FROM project_groups WHERE repo_key IS NOT NULL GROUP BY ALL),
project_labels AS (
  SELECT repo_key, name AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY tier, n DESC, length(name), name) AS rn FROM candidates) WHERE rn = 1),
project_rows AS (
  SELECT day, coalesce(l.label, g.slug) AS label, coalesce('repo:' || g.repo_key, 'slug:' || g.slug) AS member,
    sum(micro) AS micro, sum(unpriced) AS unpriced, sum(n) AS n
  FROM project_groups g LEFT JOIN project_labels l ON g.repo_key = l.repo_key GROUP BY ALL)
"""

REPO_CTE = """
session_groups AS (
  SELECT session_id, day, repo_key, slug, max(repo_name) AS repo_name, sum(paid) AS micro, sum(unp) AS unpriced, count(*) AS n
  FROM usage GROUP BY session_id, day, repo_key, slug),
spread AS (
  SELECT g.day, g.session_id, t.repo_key, t.name AS slug, t.name AS repo_name, micro, unpriced, n
  FROM session_groups g JOIN tags t ON g.session_id = t.session_id
  UNION ALL
  SELECT g.day, g.session_id, g.repo_key, g.slug, g.repo_name, micro, unpriced, n
  FROM session_groups g WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE t.session_id = g.session_id)),
repo_candidates AS (
  SELECT repo_key, 0 AS tier, repo_name AS name, sum(n) AS n FROM spread WHERE repo_key IS NOT NULL AND repo_name IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT repo_key, 1, slug, sum(n) FROM spread WHERE repo_key IS NOT NULL GROUP BY ALL),
plain_labels AS (
  SELECT repo_key, name AS plain FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY tier, n DESC, length(name), name) AS rn FROM repo_candidates) WHERE rn = 1),
repo_tab_labels AS (
  SELECT repo_key, CASE WHEN nth = 1 THEN plain ELSE plain || ' (' || nth || ')' END AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY plain ORDER BY repo_key) AS nth FROM plain_labels))
"""

IN_WEEK = f"ts >= TIMESTAMP '{A.WEEK[0]}' AND ts <= TIMESTAMP '{A.WEEK[1]}'"
SPLITS = {
    "cost_by_machine": (f"SELECT day, machine_id AS label, {MEASURES} FROM usage GROUP BY day, machine_id",),
    "cost_by_model": (f"SELECT day, nmodel AS label, {MEASURES} FROM usage GROUP BY day, nmodel",),
    "cost_by_project": (
        f"SELECT day, label, {usd('micro')} AS cost_usd, cast(unpriced AS BIGINT) AS unpriced_events, cast(n AS BIGINT) AS event_count FROM project_rows",
        PROJECT_CTE,
    ),
    "cost_by_repo": (
        f"""SELECT day, coalesce(label, '(unattributed)') AS label, {FOLDED}
            FROM spread s LEFT JOIN repo_tab_labels l ON s.repo_key = l.repo_key GROUP BY ALL""",
        TAG_CTE, REPO_CTE,
    ),
}

ORACLES = {
    **{name: query(*parts) for name, parts in SPLITS.items()},
    **{f"{name}_week": query(*parts, where=IN_WEEK) for name, parts in SPLITS.items()},
    "repo_labels": query("SELECT repo_key, label FROM repo_tab_labels", TAG_CTE, REPO_CTE),
    "dimension_totals": query(
        f"SELECT row_number() OVER (ORDER BY sum(micro) DESC, label) - 1 AS place, label, {FOLDED} FROM project_rows GROUP BY label", PROJECT_CTE
    ),
    "dimension_domain": query(
        "SELECT row_number() OVER (ORDER BY micro DESC, label) - 1 AS place, label FROM (SELECT label, sum(micro) AS micro FROM project_rows GROUP BY label)",
        PROJECT_CTE,
    ),
    "series_slots": query(
        """, shown AS (SELECT label, row_number() OVER (ORDER BY micro DESC, label) - 1 AS place FROM
              (SELECT nmodel AS label, sum(paid) AS micro FROM usage GROUP BY 1) QUALIFY place < 5),
           domain AS (SELECT label, row_number() OVER (ORDER BY micro DESC, label) - 1 AS slot FROM
              (SELECT nmodel AS label, sum(paid) AS micro FROM usage WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1) QUALIFY slot < 5),
           placed AS (SELECT s.label, s.place, d.slot FROM shown s LEFT JOIN domain d ON s.label = d.label),
           waiting AS (SELECT label, row_number() OVER (ORDER BY place) AS nth FROM placed WHERE slot IS NULL),
           free AS (SELECT n AS slot, row_number() OVER (ORDER BY n) AS nth FROM range(5) t(n) WHERE n NOT IN (SELECT slot FROM placed WHERE slot IS NOT NULL))
           SELECT p.label, p.place, coalesce(p.slot, f.slot) AS slot
           FROM placed p LEFT JOIN waiting w ON p.label = w.label LEFT JOIN free f ON w.nth = f.nth"""
    ).replace("\n, shown", ", shown"),
    "cost_series_top5": query(
        f"""SELECT CASE WHEN bar = 0 THEN '2024-01-01' ELSE strftime(DATE '2024-01-02' + cast((bar - 1) * 2 AS INTEGER), '%Y-%m-%d') || '…' || strftime(DATE '2024-01-03' + cast((bar - 1) * 2 AS INTEGER), '%Y-%m-%d') END AS day,
              CASE WHEN is_other THEN 'Other' ELSE label END AS series, is_other, {FOLDED}
            FROM (SELECT *, CASE WHEN day = '2024-01-01' THEN 0 ELSE 1 + (cast(day AS DATE) - DATE '2024-01-02') // 2 END AS bar,
                    label NOT IN (SELECT label FROM project_rows GROUP BY label ORDER BY sum(micro) DESC, label LIMIT 5) AS is_other FROM project_rows)
            GROUP BY 1, 2, 3""",
        PROJECT_CTE,
    ),
    "unpriced_days": query(
        """SELECT count(*) AS day_count, cast(sum(u) AS BIGINT) AS event_count, string_agg(day, ',' ORDER BY day) AS days,
             concat(count(*), CASE WHEN count(*) = 1 THEN ' day' ELSE ' days' END, ' in this range include ', cast(sum(u) AS BIGINT),
               CASE WHEN sum(u) = 1 THEN ' unpriced event' ELSE ' unpriced events' END, ' — totals are a lower bound') AS notice
           FROM (SELECT day, sum(unp) AS u FROM usage GROUP BY day HAVING sum(unp) > 0)"""
    ),
}
