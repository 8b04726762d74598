"""Per-session readouts over deduplicated turns: report, subagent spend, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.functions import money
from spendmart.functions.models import normalize_model
from spendmart.operators.filters import Instant, instant
from spendmart.operators.pricing import next_turn_carry, price_asof, turn_cost
from spendmart.schemas import MONEY

SYNTHETIC = "<synthetic>"
COMPACTION_FRACTION = 0.8


def cost_turns(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds `cost_micro` to turns; unknown models cost nothing here."""
    return price_asof(turns, prices).withColumn("cost_micro", turn_cost()).select(*turns.columns, "cost_micro")


def _summed(condition, value):
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def session_readout(turns: DataFrame, prices: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per session with everything a report or a status line shows.

    `turns` carries session_id, ord (any orderable), is_subagent_file, model, ts, the five counters and
    cache_creation_tokens. Grouped by (session, model) first, then by session: one scan, two small steps.
    """
    costed = cost_turns(turns, prices)
    main = ~F.col("is_subagent_file")
    last = F.struct("ord", "model", "ts", "input_tokens", "cache_creation_tokens", "cache_read_tokens", "cost_micro")
    per_model = costed.groupBy("session_id", normalize_model(F.col("model")).alias("_model")).agg(
        F.count_if(main).alias("_turns"),
        _summed(main, F.col("cost_micro")).alias("_main"),
        _summed(~main, F.col("cost_micro")).alias("_sub"),
        F.max(F.when(main & (F.col("model") != SYNTHETIC), last)).alias("_real"),
        F.max(F.when(main, last)).alias("_last"),
    )
    sessions = per_model.groupBy("session_id").agg(
        F.sum("_turns").alias("turn_count"),
        F.sum("_main").alias("session_micro"),
        F.sum("_sub").alias("subagent_micro"),
        F.max("_real").alias("_real"),
        F.max("_last").alias("_last"),
        F.min_by("_model", F.when(F.col("_turns") > 0, F.struct((-F.col("_main")).alias("c"), "_model"))).alias("top_model"),
    )
    context = F.col("_real.input_tokens") + F.col("_real.cache_creation_tokens") + F.col("_real.cache_read_tokens")
    known = sessions.withColumn("context_tokens", F.coalesce(context, F.lit(0))).withColumn("_at_model", F.col("_real.model")).withColumn(
        "_at", F.col("_real.ts")
    )
    priced = price_asof(known, prices, "_at_model", "_at").withColumn("carry_micro", next_turn_carry(F.col("context_tokens")))
    windowed = priced.withColumn("_window_key", normalize_model(F.col("_at_model"))).join(
        windows, F.col("_window_key") == F.col("window_model"), "left"
    )
    spent = (F.col("session_micro") + F.col("subagent_micro")).cast("double")
    return windowed.select(
        "session_id",
        "turn_count",
        "session_micro",
        "subagent_micro",
        F.when(spent != 0, F.col("subagent_micro").cast("double") / spent).alias("subagent_share"),
        "context_tokens",
        "carry_micro",
        "top_model",
        F.coalesce("context_window", F.lit(0).cast("bigint")).alias("context_window"),
        F.col("price_model").isNotNull().alias("priced"),
        F.coalesce("_last.cost_micro", F.lit(0).cast(MONEY)).alias("last_turn_micro"),
        (
            (F.col("turn_count") >= 2)
            & F.coalesce(F.col("_last.cache_creation_tokens") > F.col("_last.cache_read_tokens"), F.lit(False))
        ).alias("cache_miss"),
    )


def report_models(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """Turns and cost per session and model, main transcripts only."""
    main = cost_turns(turns, prices).filter(~F.col("is_subagent_file"))
    return main.groupBy("session_id", normalize_model(F.col("model")).alias("model")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("cost_micro").alias("cost_micro")
    )


def subagent_cost_since(turns: DataFrame, prices: DataFrame, cutoff: Instant) -> DataFrame:
    """What subagent transcripts spent strictly after an instant, per session. Turns are filtered before they are priced."""
    recent = turns.filter(F.col("is_subagent_file") & (F.col("ts") > instant(cutoff)))
    return cost_turns(recent, prices).groupBy("session_id").agg(F.sum("cost_micro").alias("cost_micro"))


def session_health(readout: DataFrame) -> DataFrame:
    """Only the conditions worth interrupting for. A model of unknown window never warns about its context."""
    fraction = F.when(F.col("context_window") > 0, F.col("context_tokens") / F.col("context_window"))
    near = F.coalesce(fraction >= COMPACTION_FRACTION, F.lit(False))
    warnings = F.filter(
        F.array(F.when(near, "compaction near"), F.when(F.col("cache_miss"), "cache miss")), lambda w: w.isNotNull()
    )
    return readout.select(
        "session_id", "turn_count", "context_tokens", "context_window", fraction.alias("context_fraction"),
        money.dollars(F.col("last_turn_micro")).alias("last_turn_usd"), money.dollars(F.col("carry_micro")).alias("carry_usd"),
        money.dollars(F.col("subagent_micro")).alias("subagent_usd"), "priced", F.array_join(warnings, ", ").alias("warnings"),
    )
