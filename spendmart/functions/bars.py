"""At most twenty equal bars over n items; what does not divide goes to the oldest bar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BARS = 20


Count = Column | int


def _whole(count: Count) -> Column:
    return F.lit(count).cast("bigint") if isinstance(count, int) else count


def bar_span(count: Count) -> Column:
    """Items per bar. A count known beforehand gives a literal, which keeps everything built on it small."""
    if isinstance(count, int):
        return F.lit(max(1, -(-count // MAX_BARS))).cast("bigint")
    return F.greatest(F.lit(1), F.ceil(count / F.lit(MAX_BARS))).cast("bigint")


def bar_rest(count: Count) -> Column:
    """Items of the oldest bar when it is a short one, else 0."""
    if isinstance(count, int):
        return F.lit(count % max(1, -(-count // MAX_BARS))).cast("bigint")
    return count % bar_span(count)


def bar_of(position: Column, count: Count) -> Column:
    """Bar of the item at a zero-based position."""
    rest = bar_rest(count)
    later = F.floor((position - rest) / bar_span(count)) + F.when(rest == 0, 0).otherwise(1)
    return F.when(position < rest, 0).otherwise(later).cast("bigint")


def bar_first(position: Column, count: Count) -> Column:
    """Position of the first item in the bar holding `position`."""
    rest = bar_rest(count)
    return F.when(position < rest, 0).otherwise(position - F.pmod(position - rest, bar_span(count))).cast("bigint")


def bar_last(position: Column, count: Count) -> Column:
    rest, span = bar_rest(count), bar_span(count)
    return F.when(position < rest, rest - 1).otherwise(position - F.pmod(position - rest, span) + span - 1).cast("bigint")


def turn_label(first: Column, last: Column) -> Column:
    """`Turn 3` or `Turns 3–5` of zero-based positions."""
    low, high = (first + 1).cast("string"), (last + 1).cast("string")
    return F.when(first == last, F.concat(F.lit("Turn "), low)).otherwise(F.concat(F.lit("Turns "), low, F.lit("–"), high))


def day_label(first: Column, last: Column) -> Column:
    low, high = first.cast("string"), last.cast("string")
    return F.when(first == last, low).otherwise(F.concat(low, F.lit("…"), high))


def day_bar_label(day: Column, first_day: Column | dt.date, last_day: Column | dt.date) -> Column:
    """Label of the bar a DATE falls in, for a window of calendar days; a day outside keeps its own name."""
    if isinstance(first_day, dt.date) and isinstance(last_day, dt.date):
        count: Count = (last_day - first_day).days + 1
        first_day, last_day = F.lit(first_day), F.lit(last_day)
    else:
        count = (F.datediff(last_day, first_day) + 1).cast("bigint")
    position = F.datediff(day, first_day).cast("bigint")
    first = F.date_add(first_day, bar_first(position, count).cast("int"))
    last = F.date_add(first_day, bar_last(position, count).cast("int"))
    return F.when(day.between(first_day, last_day), day_label(first, last)).otherwise(day.cast("string"))


def axis_tick(label: Column) -> Column:
    return F.substring(label, 3, 8)
