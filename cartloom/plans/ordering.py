"""Global order inside groups of any size, without one task per group.

A window over a group puts the whole group in one task. Here rows are range
partitioned on (group, order) instead, so a group that holds a third of all rows
spreads over a third of the partitions. ``slot`` is a surrogate that follows the
order; its high bits are the partition and a run of rows in it, called the *chunk*.
Prefix sums then need one small row per (group, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.plans.pinning import pin_table

#: A chunk is so many (2 ** bits) rows of one partition at most, so no task depends on partition sizes.
CHUNK_BITS = 19
#: Rows without an item go to so many parts of a join.
NULL_SPREAD = 1024


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where a missing key equals a missing key; keeps the key columns of the left side."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    cond = reduce(and_, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def join_on_item(lines: DataFrame, named: DataFrame, how: str) -> DataFrame:
    """Join on ``item``. Lines without one match nothing: they are spread, not sent to one task."""
    part = F.when(F.col("item").isNull(), F.pmod(F.xxhash64(*lines.columns), F.lit(NULL_SPREAD))).otherwise(0)
    right = named.withColumn("__spread", F.lit(0).cast("long"))
    return lines.withColumn("__spread", part).join(right, ["item", "__spread"], how).drop("__spread")


def ordered_slots(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` with ``slot`` and ``chunk`` (bigint), pinned.

    The range bounds come from a sample, so the result is written once; computing it
    twice could cut the ranges differently. The order must be total.
    """
    keys = [F.col(k).asc_nulls_last() for k in by] + list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    slotted = spread.withColumn("slot", F.monotonically_increasing_id())
    return pin_table(slotted).withColumn("chunk", F.shiftright("slot", CHUNK_BITS))


def running_offsets(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str) -> DataFrame:
    """``df`` with ``before`` (sum of ``weight`` ahead of the row in its group) and ``total``."""
    slots = ordered_slots(df, by, order)
    part = [*by, "chunk"]
    sums = slots.groupBy(*part).agg(F.sum(weight).alias("chunk_sum"))
    # a row per chunk
    across = Window.partitionBy(*by)
    offsets = sums.select(
        *part,
        (F.sum("chunk_sum").over(across.orderBy("chunk")) - F.col("chunk_sum")).alias("chunk_before"),
        F.sum("chunk_sum").over(across).alias("total"),
    )
    inside = Window.partitionBy(*part).orderBy("slot")
    local = slots.withColumn("local_before", F.sum(weight).over(inside) - F.col(weight))
    return (
        join_on_keys(local, offsets, part)
        .withColumn("before", F.col("chunk_before") + F.col("local_before"))
        .drop("slot", "chunk", "local_before", "chunk_before")
    )
