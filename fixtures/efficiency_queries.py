"""Savings, model mix, subagent share, month to date, windows and bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fixtures import adapter as A
from fixtures.sql import query, usd
from spendmart.functions import clock, money
from spendmart.operators import efficiency as E
from spendmart.operators import splits, windows
from spendmart.schemas import Dimension

_date = dt.date.fromisoformat


def _by_model(spark, sf):
    return E.efficiency_by_model(A.usage_events(spark, sf), A.prices(spark), A.FROM, A.TO)


def _usd(*names):
    return [money.dollars(F.col(n)).alias(n.replace("_micro", "_usd")) for n in names]


def efficiency_by_model(spark, sf):
    return _by_model(spark, sf).select(
        "day", "model", *_usd("cost_micro", "subagent_micro", "gross_micro", "premium_micro", "net_micro"),
        *E.EFFICIENCY_SUMS[2:], "savings_known",
    )


def efficiency_daily(spark, sf):
    return E.efficiency_by_day(_by_model(spark, sf)).select("day", *_usd("cost_micro", "subagent_micro"), *E.EFFICIENCY_SUMS[2:])


def savings_daily(spark, sf):
    return E.savings_by_day(_by_model(spark, sf)).select("day", *_usd("gross_micro", "net_micro"), "savings_known", "event_count")


def savings_summary(spark, sf):
    return E.savings_summary(E.savings_by_day(_by_model(spark, sf))).select(*_usd("net_micro"), "is_floor")


def model_mix(spark, sf):
    return E.mix_of_top(_by_model(spark, sf))


def subagent_share(spark, sf):
    barred = splits.bucket_rows(_by_model(spark, sf), _date("2024-01-01"), _date("2024-01-31"))
    shared = E.with_subagent_share(E.efficiency_by_day(barred)).select("day", "share", "share_percent", "event_count")
    return windows.fill_bars(shared, windows.bar_labels(spark, "2024-01-01", "2024-01-31"), {"event_count": 0})


def month_kpi(spark, sf):
    return E.month_to_date(A.usage_events(spark, sf), A.NOW)


def bucketed_cost(spark, sf):
    """Days re-keyed to bars over a window that starts before the data, so some bars are empty."""
    rows = splits.cost_per_day(A.usage_events(spark, sf), Dimension.MACHINE, A.FROM, A.TO)
    low, high = _date("2023-12-15"), _date("2024-01-31")
    barred = splits.bucket_rows(rows, low, high).groupBy("day").agg(*splits.merged_sums())
    filled = windows.fill_bars(
        barred, windows.bar_labels(spark, "2023-12-15", "2024-01-31"), {"unpriced_events": 0, "event_count": 0}
    )
    return filled.select("bar", "day", F.coalesce(money.dollars(F.col("cost_micro")), F.lit(0.0)).alias("cost_usd"), "unpriced_events", "event_count")


def earliest_event(spark, sf):
    return windows.earliest_event(A.table(spark, sf, "events")).select(
        F.date_format("earliest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("earliest")
    )


REQUESTS = [
    ("today", None, None),
    ("7d", None, None),
    ("30d", None, None),
    ("90d", None, None),
    ("all", None, None),
    ("yesterday", None, None),
    (None, "2024-01-10", "2024-01-12"),
    (None, "2023-12-01", "2024-03-01"),
    (None, "2024-01-12", "2024-01-10"),
    ("7d", "2024-02-30", "2024-03-01"),
]


def window_presets(spark, sf):
    earliest = windows.earliest_event(A.table(spark, sf, "events"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS").alias(c)
    every = None
    for n, (preset, low, high) in enumerate(REQUESTS):
        row = windows.window_of(earliest, A.NOW, preset, low, high).select(
            F.lit(n).cast("bigint").alias("request"), "preset", stamp("from_ts"), stamp("to_ts"), "fell_back"
        )
        every = row if every is None else every.unionByName(row)
    return every


def day_buckets(spark, sf):
    window = windows.window_of(windows.earliest_event(A.table(spark, sf, "events")), A.NOW, "all")
    return windows.day_bars(window)


def window_cost(spark, sf):
    """The last seven days resolved from the data and used as a filter without a collect."""
    window = windows.window_of(windows.earliest_event(A.table(spark, sf, "events")), A.NOW, "7d")
    rows = splits.cost_per_day(
        A.usage_events(spark, sf), Dimension.MODEL, windows.bound(window, "from_ts"), windows.bound(window, "to_ts")
    )
    return rows.select("day", "label", money.dollars(F.col("cost_micro")).alias("cost_usd"), "unpriced_events", "event_count")


def normalize_model(spark, sf):
    from spendmart.functions.models import normalize_model as norm

    return A.raw_events(spark, sf).groupBy("model", norm(F.col("model")).alias("normalized")).agg(F.count(F.lit(1)).alias("n"))


def turn_cost(spark, sf):
    return A.usage_events(spark, sf).select("request_id", money.dollars(F.col("cost_micro")).alias("cost_usd"), "priced")


def price_asof(spark, sf):
    from spendmart.operators.pricing import is_priced
    from spendmart.operators.pricing import price_asof as join

    priced = join(A.raw_events(spark, sf), A.prices(spark))
    return priced.groupBy("model", clock.day_key(F.col("ts")).alias("utc_day")).agg(
        F.max(F.col("in_rate").cast("double")).alias("in_rate"), F.max(F.col("out_rate").cast("double")).alias("out_rate"),
        F.bool_and(is_priced()).alias("known"), F.count(F.lit(1)).alias("n"),
    )


def carry_split(spark, sf):
    from spendmart.operators.pricing import carry_split as split

    return split(A.usage_events(spark, sf), A.prices(spark)).select("request_id", *_usd("carry_micro", "new_micro"))


def cache_savings(spark, sf):
    from spendmart.operators.pricing import cache_savings as savings

    return savings(A.usage_events(spark, sf), A.prices(spark), "model", "ts").select(
        "request_id", *_usd("gross_micro", "premium_micro", "net_micro"), "savings_known"
    )


QUERIES = {
    f.__name__: f
    for f in (
        normalize_model, price_asof, turn_cost, carry_split, cache_savings, efficiency_by_model, efficiency_daily, savings_daily,
        savings_summary, model_mix, subagent_share, month_kpi, bucketed_cost, earliest_event, window_presets, day_buckets, window_cost,
    )
}

TOKENS = ", ".join(f"cast(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens"))
GROSS = "coalesce(cast(cache_read_tokens::DECIMAL(12,0) * (inp * (1 - readm)) AS DECIMAL(38,6)), 0)"
PREMIUM = "coalesce(cast((cache_write_5m_tokens::DECIMAL(12,0) * 0.25 + cache_write_1h_tokens::DECIMAL(12,0) * 1.0) * inp AS DECIMAL(38,6)), 0)"
SUB = "sum(CASE WHEN is_subagent THEN paid ELSE 0 END)"
EFF = f"""{usd('sum(paid)')} AS cost_usd, {usd(SUB)} AS subagent_usd, count(*) AS event_count,
  cast(sum(CASE WHEN is_subagent THEN 1 ELSE 0 END) AS BIGINT) AS subagent_events, cast(sum(unp) AS BIGINT) AS unpriced_events, {TOKENS}"""
SAVED = f"sum({GROSS}) AS gross, sum({PREMIUM}) AS premium, sum({GROSS}) - sum({PREMIUM}) AS net"
LOCAL = "strftime({0} - INTERVAL 7 HOURS, '%Y-%m-%d %H:%M:%S.%g')"
NOW_SQL = "TIMESTAMP '2024-01-30 12:00:00'"


def bar_label(first: str, days: int, day: str) -> str:
    """Label of a day's bar for a window of a known number of days."""
    span = max(1, -(-days // 20))
    rest = days % span
    start = f"CASE WHEN {rest} > 0 AND d < {rest} THEN 0 ELSE {rest} + ((d - {rest}) // {span}) * {span} END"
    size = f"CASE WHEN {rest} > 0 AND d < {rest} THEN {rest} ELSE {span} END"
    return f"""(SELECT CASE WHEN {size} = 1 THEN strftime(DATE '{first}' + cast({start} AS INTEGER), '%Y-%m-%d')
        ELSE strftime(DATE '{first}' + cast({start} AS INTEGER), '%Y-%m-%d') || '…' || strftime(DATE '{first}' + cast({start} + {size} - 1 AS INTEGER), '%Y-%m-%d') END
        FROM (SELECT cast({day} AS DATE) - DATE '{first}' AS d))"""


def bar_grid(first: str, days: int) -> str:
    label = bar_label(first, days, f"DATE '{first}' + cast(n AS INTEGER)")
    return f"grid AS (SELECT row_number() OVER (ORDER BY day) - 1 AS bar, day FROM (SELECT DISTINCT {label} AS day FROM range({days}) t(n)))"


ORACLES = {
    "normalize_model": query("SELECT model, nmodel AS normalized, count(*) AS n FROM usage GROUP BY ALL"),
    "price_asof": query(
        """SELECT model, utc_day, max(cast(inp AS DOUBLE)) AS in_rate, max(cast(outp AS DOUBLE)) AS out_rate,
             bool_and(known) AS known, count(*) AS n FROM usage GROUP BY ALL"""
    ),
    "turn_cost": query(f"SELECT request_id, {usd('cost_micro')} AS cost_usd, priced FROM usage"),
    "carry_split": query(f"SELECT request_id, {usd('carry_micro')} AS carry_usd, {usd('new_micro')} AS new_usd FROM usage"),
    "cache_savings": query(
        f"SELECT request_id, {usd(GROSS)} AS gross_usd, {usd(PREMIUM)} AS premium_usd, {usd(f'({GROSS} - {PREMIUM})')} AS net_usd, known AS savings_known FROM usage"
    ),
    "efficiency_by_model": query(
        f"""SELECT day, nmodel AS model, {EFF}, {usd(f'sum({GROSS})')} AS gross_usd, {usd(f'sum({PREMIUM})')} AS premium_usd,
              {usd(f'(sum({GROSS}) - sum({PREMIUM}))')} AS net_usd, bool_and(known) AS savings_known FROM usage GROUP BY ALL"""
    ),
    "efficiency_daily": query(f"SELECT day, {EFF} FROM usage GROUP BY day"),
    "savings_daily": query(
        f"""SELECT day, {usd(f'sum({GROSS})')} AS gross_usd, {usd(f'(sum({GROSS}) - sum({PREMIUM}))')} AS net_usd,
              bool_and(known) AS savings_known, count(*) AS event_count FROM usage GROUP BY day"""
    ),
    "savings_summary": query(
        f"SELECT {usd(f'(sum({GROSS}) - sum({PREMIUM}))')} AS net_usd, NOT bool_and(known) AS is_floor FROM usage"
    ),
    "model_mix": query(
        """, top AS (SELECT nmodel FROM usage GROUP BY nmodel ORDER BY sum(paid) DESC, nmodel LIMIT 5),
           keys AS (SELECT nmodel AS series, false AS is_other FROM top UNION ALL SELECT 'Other', true),
           days AS (SELECT day, sum(paid) AS spent, count(*) AS day_events FROM usage GROUP BY day),
           parts AS (SELECT day, CASE WHEN nmodel IN (SELECT nmodel FROM top) THEN nmodel ELSE 'Other' END AS series,
             nmodel NOT IN (SELECT nmodel FROM top) AS is_other, sum(paid) AS micro FROM usage GROUP BY ALL)
           SELECT d.day, k.series, k.is_other,
             CASE WHEN spent <> 0 THEN cast(coalesce(micro, 0) AS DOUBLE) / cast(spent AS DOUBLE) END AS share, day_events
           FROM days d CROSS JOIN keys k LEFT JOIN parts p ON p.day = d.day AND p.series = k.series AND p.is_other = k.is_other"""
    ),
    "subagent_share": query(
        f"""SELECT bar, g.day, share, floor(share * 1000 + 0.5) / 10.0 AS share_percent, coalesce(event_count, 0) AS event_count
            FROM grid g LEFT JOIN (
              SELECT {bar_label('2024-01-01', 31, 'u.day')} AS day, count(*) AS event_count,
                CASE WHEN sum(paid) = 0 OR ({SUB} = 0 AND sum(CASE WHEN is_subagent THEN 1 ELSE 0 END) > 0) THEN NULL
                  ELSE cast({SUB} AS DOUBLE) / cast(sum(paid) AS DOUBLE) END AS share
              FROM usage u GROUP BY 1) x ON g.day = x.day""",
        bar_grid("2024-01-01", 31),
    ),
    "month_kpi": query(
        f"""SELECT {usd("coalesce(sum(CASE WHEN day = '2024-01-30' THEN paid END), 0)")} AS today_usd,
              cast(coalesce(sum(CASE WHEN day = '2024-01-30' THEN unp END), 0) AS BIGINT) AS today_unpriced,
              {usd('sum(paid)')} AS month_usd, cast(sum(unp) AS BIGINT) AS month_unpriced, 29::BIGINT AS complete_days,
              31::BIGINT AS days_in_month, {usd('sum(paid)')} / 29 * 31 AS projected_usd
            FROM usage WHERE ts >= TIMESTAMP '2023-12-31 17:00:00' AND ts <= {NOW_SQL}"""
    ),
    "bucketed_cost": query(
        f"""SELECT bar, g.day, coalesce(cost_usd, 0.0) AS cost_usd, coalesce(unpriced_events, 0) AS unpriced_events, coalesce(event_count, 0) AS event_count
            FROM grid g LEFT JOIN (SELECT {bar_label('2023-12-15', 48, 'u.day')} AS day, {usd('sum(paid)')} AS cost_usd,
              cast(sum(unp) AS BIGINT) AS unpriced_events, count(*) AS event_count FROM usage u GROUP BY 1) x ON g.day = x.day""",
        bar_grid("2023-12-15", 48),
    ),
    "earliest_event": "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS earliest FROM events",
    "window_presets": f"""
        WITH e AS (SELECT date_trunc('day', min(ts) + INTERVAL 7 HOURS) AS first FROM events),
        today AS (SELECT date_trunc('day', {NOW_SQL} + INTERVAL 7 HOURS) AS t0),
        asked(request, preset, low, high, fell_back) AS (
          SELECT 0, 'today', t0, NULL, false FROM today UNION ALL SELECT 1, '7d', t0 - INTERVAL 6 DAYS, NULL, false FROM today
          UNION ALL SELECT 2, '30d', t0 - INTERVAL 29 DAYS, NULL, false FROM today UNION ALL SELECT 3, '90d', t0 - INTERVAL 89 DAYS, NULL, false FROM today
          UNION ALL SELECT 4, 'all', first, NULL, false FROM e UNION ALL SELECT 5, '30d', t0 - INTERVAL 29 DAYS, NULL, true FROM today
          UNION ALL SELECT 6, 'custom', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12 23:59:59.999', false
          UNION ALL SELECT 7, 'custom', TIMESTAMP '2023-12-01', TIMESTAMP '2024-03-01 23:59:59.999', false
          UNION ALL SELECT 8, '30d', t0 - INTERVAL 29 DAYS, NULL, true FROM today UNION ALL SELECT 9, '30d', t0 - INTERVAL 29 DAYS, NULL, true FROM today)
        SELECT cast(request AS BIGINT) AS request, preset, {LOCAL.format('greatest(low, first)')} AS from_ts,
          strftime(least(coalesce(high - INTERVAL 7 HOURS, {NOW_SQL}), {NOW_SQL}), '%Y-%m-%d %H:%M:%S.%g') AS to_ts, fell_back
        FROM asked, e""",
    "day_buckets": f"""
        WITH e AS (SELECT cast(min(ts) + INTERVAL 7 HOURS AS DATE) AS first FROM events),
        n AS (SELECT first, DATE '2024-01-30' - first + 1 AS days FROM e),
        s AS (SELECT first, days, greatest(1, cast(ceil(days / 20.0) AS BIGINT)) AS span FROM n),
        d AS (SELECT first, days, span, days % span AS rest, t.i AS i FROM s, range(400) t(i) WHERE t.i < days),
        b AS (SELECT *, CASE WHEN rest > 0 AND i < rest THEN 0 ELSE (i - rest) // span + CASE WHEN rest = 0 THEN 0 ELSE 1 END END AS bar FROM d),
        l AS (SELECT *, min(i) OVER (PARTITION BY bar) AS lo, max(i) OVER (PARTITION BY bar) AS hi FROM b)
        SELECT strftime(first + cast(i AS INTEGER), '%Y-%m-%d') AS day, cast(bar AS BIGINT) AS bar,
          CASE WHEN lo = hi THEN strftime(first + cast(lo AS INTEGER), '%Y-%m-%d')
            ELSE strftime(first + cast(lo AS INTEGER), '%Y-%m-%d') || '…' || strftime(first + cast(hi AS INTEGER), '%Y-%m-%d') END AS label FROM l""",
    "window_cost": query(
        f"""SELECT day, nmodel AS label, {usd('sum(paid)')} AS cost_usd, cast(sum(unp) AS BIGINT) AS unpriced_events, count(*) AS event_count
            FROM usage WHERE ts >= TIMESTAMP '2024-01-23 17:00:00' AND ts <= {NOW_SQL} GROUP BY ALL"""
    ),
}
ORACLES["model_mix"] = ORACLES["model_mix"].replace("\n, top", ", top")
