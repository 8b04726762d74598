import datetime as dt

from pyspark.sql import functions as F

from helpers import at, dicts, event, frame
from spendmart.functions import bars, clock, money
from spendmart.operators import windows
from spendmart.schemas import DASHBOARD_ZONE


def test_bars_against_a_loop(spark):
    counts = spark.range(1, 401).select(F.col("id").alias("n"))
    got = counts.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    got = got.select("n", "i", bars.bar_of(F.col("i"), F.col("n")).alias("bar")).collect()
    expected = {}
    for n in range(1, 401):
        size, bar, i = (n % max(1, -(-n // 20))) or max(1, -(-n // 20)), 0, 0
        while i < n:
            for j in range(i, min(n, i + size)):
                expected[n, j] = bar
            i, bar, size = i + size, bar + 1, max(1, -(-n // 20))
        assert bar <= 20
    assert {(r["n"], r["i"]): r["bar"] for r in got} == expected


def test_day_labels(spark):
    low, high = dt.date(2026, 1, 1), dt.date(2026, 2, 10)
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-03",), ("2026-02-10",), ("2026-03-01",)], "d string")
    got = [r[0] for r in days.select(bars.day_bar_label(F.col("d").cast("date"), low, high)).collect()]
    as_columns = [r[0] for r in days.select(bars.day_bar_label(F.col("d").cast("date"), F.lit(low), F.lit(high))).collect()]
    assert got == as_columns == ["2026-01-01…2026-01-02", "2026-01-03…2026-01-05", "2026-02-08…2026-02-10", "2026-03-01"]
    assert dicts(windows.bar_labels(spark, "2026-01-01", "2026-01-03"), "bar") == [{"bar": n, "day": f"2026-01-0{n + 1}"} for n in range(3)]


def test_local_days_do_not_depend_on_the_session_zone(spark):
    rows = frame(spark, event(1, ts=at("2026-08-01T16:59:59")), event(2, ts=at("2026-08-01T17:00:00")))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = [r[0] for r in rows.orderBy("request_id").select(clock.day_key(F.col("ts"), DASHBOARD_ZONE)).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == ["2026-08-01", "2026-08-02"]


def test_day_and_month_edges_across_a_clock_change(spark):
    row = spark.range(1).select(F.lit("2026-03-08 12:00:00").cast("timestamp_ntz").alias("ts"))
    zone = "America/New_York"
    got = row.select(clock.day_start(F.col("ts"), zone), clock.day_end(F.col("ts"), zone), clock.month_start(F.col("ts"), zone)).first()
    assert tuple(got) == (at("2026-03-08T05:00:00"), at("2026-03-09T03:59:59.999"), at("2026-03-01T05:00:00"))


def test_instants_are_parsed_or_refused(spark):
    texts = ["2026-08-01T10:00:00.000Z", "2026-08-01T10:00:00+07:00", "2026-08-01T10:00:00-0330", "2026-08-01", "yesterday", "2026-13-01T00:00:00Z", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(clock.parse_instant(F.col("t"))).collect()]
    assert got == [at("2026-08-01T10:00:00"), at("2026-08-01T03:00:00"), at("2026-08-01T13:30:00"), at("2026-08-01T00:00:00"), None, None, None]


def resolve(spark, *args, earliest="2026-01-05 20:00:00", **kw):
    first = spark.range(1).select(F.lit(earliest).cast("timestamp_ntz").alias("earliest"))
    return tuple(windows.window_of(first, "2026-03-10 12:00:00", *args, **kw).first())


def test_windows(spark):
    now = at("2026-03-10T12:00:00")
    assert resolve(spark, "7d") == ("7d", at("2026-03-03T17:00:00"), now, False)
    assert resolve(spark) == ("30d", at("2026-02-08T17:00:00"), now, False)
    assert resolve(spark, "90d") == ("90d", at("2026-01-05T17:00:00"), now, False)
    assert resolve(spark, "all") == ("all", at("2026-01-05T17:00:00"), now, False)
    assert resolve(spark, "all", earliest=None) == ("30d", at("2026-02-08T17:00:00"), now, True)
    assert resolve(spark, "nonsense")[0::3] == ("30d", True)
    assert resolve(spark, None, "2026-02-01", "2026-02-03") == ("custom", at("2026-01-31T17:00:00"), at("2026-02-03T16:59:59.999"), False)
    assert resolve(spark, "7d", "2026-02-30", "2026-03-01")[0::3] == ("30d", True)
    assert resolve(spark, "7d", "2026-03-01", "2026-02-01")[0::3] == ("30d", True)
    assert resolve(spark, "7d", "2026-03-01", None)[0::3] == ("30d", True)


def test_sentences(spark):
    row = spark.range(1).select(
        money.lower_bound_text(F.lit(12.345), F.lit(0)).alias("a"),
        money.lower_bound_text(F.lit(3.0), F.lit(1)).alias("b"),
        money.savings_text(F.lit(-2.5)).alias("c"),
        money.savings_text(F.lit(1.0), F.lit(True)).alias("d"),
        money.unpriced_notice(F.lit(1), F.lit(2)).alias("e"),
        money.unpriced_notice(F.lit(0), F.lit(0)).alias("f"),
        bars.axis_tick(F.lit("2026-01-01…2026-01-02")).alias("g"),
    ).first()
    assert row["b"] == "$3.00+ (1 event unpriced)" and row["c"] == "Caching cost $2.50 more than it saved"
    assert row["d"].startswith("Caching saved $1.00 — at least") and row["f"] is None and row["g"] == "26-01-01"
    assert row["e"] == "1 day in this range include 2 unpriced events — totals are a lower bound"


def test_gap_fill_never_overwrites(spark):
    rows = spark.createDataFrame([("2026-01-02", 5)], "day string, event_count bigint")
    filled = windows.fill_bars(rows, windows.bar_labels(spark, "2026-01-01", "2026-01-03"), {"event_count": 0})
    assert [r["event_count"] for r in filled.orderBy("bar").collect()] == [0, 5, 0]
