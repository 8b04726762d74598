"""Order-dependent operators that never put one whole group into one task.

A plain window sorts a group in a single task, so one session or stream holding a third of the
data would stall the job. Here the caller names a *block*: an expression that only grows along the
order (the minute of an instant, the file split of a record). Windows run inside (group, block),
which hash partitioning spreads; a second step works on one summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def blocked_rank(
    rows: DataFrame, groups: Sequence[str], order: Sequence[Column], block: Column, rank: str = "position", total: str | None = None
) -> DataFrame:
    """Adds the zero-based rank of each row in its group's order, and the group's row count when `total` is named.

    `block` must not be NULL and must not decrease along `order`.
    """
    blocked = rows.withColumn("_block", block)
    sizes = blocked.groupBy(*groups, "_block").agg(F.count(F.lit(1)).alias("_size"))
    along = W.partitionBy(*groups).orderBy("_block")
    whole = W.partitionBy(*groups)
    offsets = sizes.select(
        *groups,
        "_block",
        (F.sum("_size").over(along) - F.col("_size")).alias("_before"),
        F.sum("_size").over(whole).alias("_total"),
    )
    inside = W.partitionBy(*groups, "_block").orderBy(*order)
    ranked = blocked.withColumn("_inner", F.row_number().over(inside) - 1)
    keys = [*groups, "_block"]
    joined = ranked.join(offsets, _same(ranked, offsets, keys), "left")
    columns = [ranked[c] for c in rows.columns] + [(F.col("_before") + F.col("_inner")).cast("bigint").alias(rank)]
    if total:
        columns.append(F.col("_total").cast("bigint").alias(total))
    return joined.select(*columns)


def blocked_previous(
    rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: Column, block: Column, name: str, include_current: bool = False
) -> DataFrame:
    """Adds the last non-NULL `value` before each row (or up to it) in its group's order."""
    blocked = rows.withColumn("_block", block).withColumn("_value", value)
    last_of_block = blocked.groupBy(*groups, "_block").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last")
    )
    earlier = W.partitionBy(*groups).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = last_of_block.select(*groups, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow if include_current else -1
    )
    local = blocked.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    joined = local.join(carried, _same(local, carried, [*groups, "_block"]), "left")
    return joined.select(*[local[c] for c in rows.columns], F.coalesce("_local", "_carried").alias(name))
