"""Money and the sentences built around it. Sums stay exact decimals; dollars appear at the edge.

fixed values: the wording of the sentences and the two-decimal dollar format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendmart.schemas import MONEY


def gated(cost_micro: Column, priced: Column) -> Column:
    """Cost when it can be trusted, else zero."""
    return F.when(priced, cost_micro).otherwise(F.lit(0).cast(MONEY))


def unpriced(priced: Column) -> Column:
    return F.when(F.coalesce(priced, F.lit(False)), 0).otherwise(1)


def dollars(micro: Column) -> Column:
    """Micro-dollars to DOUBLE dollars; only ever applied to a finished sum."""
    return micro.cast("double") / F.lit(1000000.0)


def cents_text(usd: Column) -> Column:
    """`$1.23`, never scientific."""
    return F.concat(F.lit("$"), F.round(usd, 2).cast("decimal(38,2)").cast("string"))


def noun(count: Column, word: str) -> Column:
    return F.when(count == 1, word).otherwise(f"{word}s")


def lower_bound_text(usd: Column, unpriced_events: Column) -> Column:
    """A cost, marked as a floor when events without a price went into it."""
    note = F.concat(F.lit("+ ("), unpriced_events.cast("string"), F.lit(" "), noun(unpriced_events, "event"), F.lit(" unpriced)"))
    return F.concat(cents_text(usd), F.when(unpriced_events == 0, "").otherwise(note))


def savings_text(net_usd: Column, is_floor: Column | None = None) -> Column:
    said = F.when(
        net_usd < 0, F.concat(F.lit("Caching cost "), cents_text(F.abs(net_usd)), F.lit(" more than it saved"))
    ).otherwise(F.concat(F.lit("Caching saved "), cents_text(net_usd)))
    if is_floor is None:
        return said
    return F.concat(
        said, F.when(is_floor, F.lit(" — at least, some models in this range have no known price")).otherwise("")
    )


def unpriced_notice(days: Column, events: Column) -> Column:
    """NULL when no day is affected."""
    return F.when(
        days > 0,
        F.concat(
            days.cast("string"), F.lit(" "), noun(days, "day"), F.lit(" in this range include "),
            events.cast("string"), F.lit(" unpriced "), noun(events, "event"), F.lit(" — totals are a lower bound"),
        ),
    )


def turn_label_text(label: Column, unpriced_events: Column) -> Column:
    note = F.concat(F.lit(" ("), unpriced_events.cast("string"), F.lit(" "), noun(unpriced_events, "event"), F.lit(" unpriced)"))
    return F.concat(label, F.when(unpriced_events == 0, "").otherwise(note))


def divergence_note(chart_micro: Column, total_micro: Column) -> Column:
    """NULL when the chart adds up to the total. Compared as exact decimals."""
    return F.when(
        chart_micro != total_micro,
        F.concat(
            F.lit("This chart totals "), cents_text(dollars(chart_micro)), F.lit(", more than the "),
            cents_text(dollars(total_micro)),
            F.lit(" total above — a price change since these turns ran raised some turns' re-priced carry above what they were actually billed."),
        ),
    )


def empty_timeline_text(turns: Column, unpriced_events: Column) -> Column:
    return F.when(
        unpriced_events >= turns, "Every turn in this session is unpriced — nothing to chart yet."
    ).otherwise("Every turn in this session cost $0.00.")
