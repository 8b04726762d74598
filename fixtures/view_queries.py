"""Composed cards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixtures import adapter as A
from fixtures import ingest_queries as I
from fixtures.efficiency_queries import GROSS, ORACLES as EFFICIENCY_SQL, PREMIUM, bar_grid, bar_label
from fixtures.ingest_queries import NAME_CTE
from fixtures.session_queries import LIFETIME, IN_WEEK, WEEK, grouped
from fixtures.split_queries import FOLDED
from fixtures.sql import query, usd
from spendmart.functions import money
from spendmart.operators import efficiency, sessions, splits
from spendmart.operators.machines import latest_names, machine_status
from spendmart.plans import views
from spendmart.schemas import Dimension

LOW, HIGH = dt.date(2023, 12, 15), dt.date(2024, 1, 31)


def _usd(*names):
    return [money.dollars(F.col(n)).alias(n.replace("_micro", "_usd")) for n in names]


def _nicknames(spark, sf):
    return latest_names(I._name_feed(spark, sf), A.raw_events(spark, sf).select("machine_id").distinct())


def view_machine_totals(spark, sf):
    events = A.usage_events(spark, sf)
    rows = splits.cost_per_day(events, Dimension.MACHINE, A.FROM, A.TO)
    domain = splits.dimension_domain(events, Dimension.MACHINE, A.FROM, A.TO)
    table = views.with_display_names(views.totals_table(rows, domain), "label", _nicknames(spark, sf))
    return table.select("label", "display_name", "slot", *_usd("cost_micro"), "unpriced_events", "event_count")


def view_cost_chart(spark, sf):
    rows = splits.cost_per_day(A.usage_events(spark, sf), Dimension.MACHINE, A.FROM, A.TO)
    chart = views.cost_chart(rows, LOW, HIGH)
    shown = F.aggregate(F.map_values("shown"), F.lit(0).cast("decimal(38,6)"), lambda a, b: (a + b).cast("decimal(38,6)"))
    return chart.select(
        "bar", "day", F.coalesce(F.size("shown"), F.lit(0)).cast("bigint").alias("shown_series"), money.dollars(shown).alias("shown_usd"),
        *_usd("other_micro"), "unpriced_events", "event_count",
    )


def view_savings(spark, sf):
    by_model = efficiency.efficiency_by_model(A.usage_events(spark, sf), A.prices(spark), A.FROM, A.TO)
    return views.savings_card(by_model, LOW, HIGH).select("bar", "day", *_usd("net_micro"), "savings_known", "event_count")


def view_session_table(spark, sf):
    page = sessions.list_sessions(A.usage_events(spark, sf), *WEEK)
    table = views.session_table(page, _nicknames(spark, sf))
    return table.select(
        "session_id", "name", "project", "machine", "models", "started", "event_count", "cost", "whole_session", F.col("whole_session").isNotNull().alias("reaches_outside"),
    )


def view_mix(spark, sf):
    by_model = efficiency.efficiency_by_model(A.usage_events(spark, sf), A.prices(spark), A.FROM, A.TO)
    return views.mix_card(by_model, LOW, HIGH).select("bar", "day", "series", "is_other", "share", "day_events")


def view_kpi(spark, sf):
    return views.kpi_card(efficiency.month_to_date(A.usage_events(spark, sf), A.NOW))


def view_machine_tile(spark, sf):
    roster = I._roster(spark, sf)
    status = views.machine_tile(machine_status(roster, latest_names(I._name_feed(spark, sf), roster), A.NOW))
    return _tile_place(status).select("place", "machine_id", "display_name", "stale")


def _tile_place(tiles):
    """The place of each tile; there are as many as machines have names to show."""
    return tiles.withColumn("place", F.row_number().over(W.orderBy("display_name", "machine_id")).cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (view_machine_totals, view_cost_chart, view_savings, view_session_table, view_mix, view_kpi, view_machine_tile)
}

NAMES = NAME_CTE + """, nick AS (SELECT machine_id, nullif(arg_max(cleaned, seq), '') AS name FROM feed WHERE allowed GROUP BY machine_id)"""
TOTALS = "tot AS (SELECT machine_id AS label, sum(paid) AS micro, sum(unp) AS unpriced, count(*) AS n FROM usage GROUP BY 1)"
TOP = "top AS (SELECT label FROM tot ORDER BY micro DESC, label LIMIT 5)"



def floor_text(cost: str, unpriced: str) -> str:
    """Dollars and cents, with the note on events without a price."""
    return f"""concat('$', cast(cast(round({cost}, 2) AS DECIMAL(38,2)) AS VARCHAR),
      CASE WHEN {unpriced} = 0 THEN '' ELSE concat('+ (', {unpriced}, CASE WHEN {unpriced} = 1 THEN ' event' ELSE ' events' END, ' unpriced)') END)"""


ORACLES = {
    "view_machine_totals": query(
        f"""SELECT label, coalesce(name, left(label, 8)) AS display_name, CASE WHEN place < 5 THEN place END AS slot,
              {usd('micro')} AS cost_usd, cast(unpriced AS BIGINT) AS unpriced_events, n AS event_count
            FROM (SELECT *, row_number() OVER (ORDER BY micro DESC, label) - 1 AS place FROM tot) t LEFT JOIN nick ON machine_id = label""",
        NAMES, TOTALS,
    ),
    "view_cost_chart": query(
        f"""SELECT bar, g.day, coalesce(shown_series, 0) AS shown_series, shown_usd, other_usd, coalesce(unpriced_events, 0) AS unpriced_events, coalesce(event_count, 0) AS event_count
            FROM grid g LEFT JOIN (SELECT {bar_label('2023-12-15', 48, 'u.day')} AS day,
              count(DISTINCT machine_id) FILTER (machine_id IN (SELECT label FROM top)) AS shown_series,
              {usd('sum(CASE WHEN machine_id IN (SELECT label FROM top) THEN paid ELSE 0 END)')} AS shown_usd,
              {usd('sum(CASE WHEN machine_id NOT IN (SELECT label FROM top) THEN paid END)')} AS other_usd,
              cast(sum(unp) AS BIGINT) AS unpriced_events, count(*) AS event_count FROM usage u GROUP BY 1) x ON g.day = x.day""",
        TOTALS, TOP, bar_grid("2023-12-15", 48),
    ),
    "view_savings": query(
        f"""SELECT bar, g.day, net_usd, coalesce(savings_known, true) AS savings_known, coalesce(event_count, 0) AS event_count
            FROM grid g LEFT JOIN (SELECT {bar_label('2023-12-15', 48, 'u.day')} AS day, {usd(f'(sum({GROSS}) - sum({PREMIUM}))')} AS net_usd,
              bool_and(known) AS savings_known, count(*) AS event_count FROM usage u GROUP BY 1) x ON g.day = x.day""",
        bar_grid("2023-12-15", 48),
    ),
    "view_session_table": query(
        f"""SELECT session_id, coalesce(session_title, left(session_id, 8)) AS name, project_slug AS project, coalesce(nick.name, left(s.machine_id, 8)) AS machine,
              replace(models, ',', ', ') AS models, strftime(s_at + INTERVAL 7 HOURS, '%Y-%m-%d %H:%M:%S') AS started, event_count,
              {floor_text(usd('micro'), 'unpriced_events')} AS cost,
              CASE WHEN total_usd <> {usd('micro')} THEN concat('whole session ', {floor_text('total_usd', 'total_unpriced')}) END AS whole_session,
              total_usd <> {usd('micro')} AS reaches_outside
            FROM (SELECT * FROM s ORDER BY micro DESC, session_id LIMIT 25) s JOIN life USING (session_id) LEFT JOIN nick ON nick.machine_id = s.machine_id""",
        NAMES, f"s AS ({grouped('usage', where=IN_WEEK)})", LIFETIME,
    ),
    "view_mix": query(
        f"""SELECT g.bar, g.day, k.series, k.is_other,
              CASE WHEN spent <> 0 THEN cast(coalesce(micro, 0) AS DOUBLE) / cast(spent AS DOUBLE) END AS share, coalesce(day_events, 0) AS day_events
            FROM grid g LEFT JOIN barred d ON g.day = d.day LEFT JOIN keys k ON d.day IS NOT NULL
              LEFT JOIN parts p ON p.day = g.day AND p.series = k.series AND p.is_other = k.is_other""",
        "top AS (SELECT nmodel FROM usage GROUP BY nmodel ORDER BY sum(paid) DESC, nmodel LIMIT 5)",
        "keys AS (SELECT nmodel AS series, false AS is_other FROM top UNION ALL SELECT 'Other', true)",
        f"u AS (SELECT {bar_label('2023-12-15', 48, 'usage.day')} AS day, nmodel, paid FROM usage)",
        "barred AS (SELECT day, sum(paid) AS spent, count(*) AS day_events FROM u GROUP BY day)",
        """parts AS (SELECT day, CASE WHEN nmodel IN (SELECT nmodel FROM top) THEN nmodel ELSE 'Other' END AS series,
             nmodel NOT IN (SELECT nmodel FROM top) AS is_other, sum(paid) AS micro FROM u GROUP BY ALL)""",
        bar_grid("2023-12-15", 48),
    ),
    "view_kpi": f"""SELECT {floor_text('today_usd', 'today_unpriced')} AS today, {floor_text('month_usd', 'month_unpriced')} AS month,
          {floor_text('projected_usd', 'month_unpriced')} AS projected,
          concat('Projected from ', complete_days, ' complete days of ', days_in_month) AS projected_note FROM ({EFFICIENCY_SQL['month_kpi']})""",
    "view_machine_tile": f"""SELECT row_number() OVER (ORDER BY display_name, machine_id) AS place, machine_id, display_name, stale
          FROM ({I.ORACLES['machine_status']})""",
}
