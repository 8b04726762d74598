"""Which account was active: change capture into a ledger, and the as-of join from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendmart.operators.ordered import blocked_previous

PLAUSIBLE_GAP = "interval 24 hours"


def ledger_changes(observations: DataFrame, order: list[str], block) -> DataFrame:
    """Observations (session_id, account_uuid, org_uuid, at, …) that differ from the session's previous one."""
    account = F.struct("account_uuid", "org_uuid")
    previous = blocked_previous(observations, ["session_id"], order, account, block, "_previous")
    return previous.filter(~account.eqNullSafe(F.col("_previous"))).drop("_previous")


def account_marks(ledger: DataFrame) -> DataFrame:
    """(session_id, ts, account): the instants at which the answer of the ledger changes.

    In force is the last entry in list order (`pos`) already begun. An entry begins to matter only if no
    later one has begun before it. Before all of them the first entry holds for at most a day.
    """
    later = W.partitionBy("session_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("session_id")
    account = F.struct("account_uuid", "org_uuid")
    dated = ledger.select(
        "session_id",
        "from_ts",
        account.alias("account"),
        F.min("from_ts").over(later).alias("_next"),
        F.min("from_ts").over(whole).alias("_earliest"),
        (F.col("pos") == F.min("pos").over(whole)).alias("_is_first"),
    )
    begun = F.when(F.col("_next").isNull() | (F.col("from_ts") < F.col("_next")), F.col("from_ts"))
    guess = F.when(F.col("_is_first") & (F.col("from_ts") - F.expr(PLAUSIBLE_GAP) < F.col("_earliest")), F.col("from_ts") - F.expr(PLAUSIBLE_GAP))
    marks = dated.select("session_id", "account", F.explode(F.array(begun, guess)).alias("ts"))
    return marks.filter(F.col("ts").isNotNull())


def account_cells(cells: DataFrame, ledger: DataFrame) -> DataFrame:
    """(session_id, _hour, from_ts, until_ts, account): what is in force from when to when, inside one hour of a session.

    `cells` are the hours that matter, (session_id, _hour). Marks and cells of a session meet in one window, which holds no
    event; a cell takes what was in force before its hour, and a mark holds to the next one or to the end of its hour.
    """
    marks = account_marks(ledger).select("session_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("_hour"), F.col("ts").alias("from_ts"), F.lit(1).alias("_rank"), "account")
    asked = cells.select("session_id", "_hour", F.col("_hour").alias("from_ts"), F.lit(0).alias("_rank"), F.lit(None).cast(marks.schema["account"].dataType).alias("account"))
    along = W.partitionBy("session_id").orderBy("from_ts", "_rank")
    following = F.lead(F.struct("_hour", "from_ts")).over(along)
    carried = F.last("account", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    pieces = marks.unionByName(asked).select("session_id", "_hour", "from_ts", following.alias("_next"), carried.alias("account"))
    until = F.when(F.col("_next._hour") == F.col("_hour"), F.col("_next.from_ts"))
    return pieces.filter(F.col("account").isNotNull()).select("session_id", "_hour", "from_ts", until.alias("until_ts"), "account")


def account_asof(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds account_uuid and org_uuid; NULL where the ledger says nothing trustworthy or the event has no instant.

    One left join on session and hour: the periods of a session are first cut to the hours in which it has events, so a
    session of many events and many entries spreads over as many tasks as it has hours, and an event meets at most one
    period. `events` are read twice, the first time for sessions and hours only.
    """
    kept = [c for c in events.columns if c not in ("account_uuid", "org_uuid")]
    timed = events.select(*kept).withColumn("_at", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    cells = timed.filter("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", F.col("_at").alias("_hour")).distinct()
    periods = account_cells(cells, ledger).toDF("_session", "_hour", "_from", "_until", "_account")
    inside = (F.col("ts") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("ts") < F.col("_until")))
    joined = timed.join(periods, (F.col("session_id") == F.col("_session")) & (F.col("_at") == F.col("_hour")) & inside, "left")
    return joined.select(*kept, F.col("_account.account_uuid").alias("account_uuid"), F.col("_account.org_uuid").alias("org_uuid"))
