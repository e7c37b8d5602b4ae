"""Carrying a value down an order: forward fill without a window over everything.

Rows are cut into blocks by the caller's number; within a block, a window fills. What enters a block is the
last value of an earlier one: blocks are gathered FAN at a time into blocks of blocks, level by level, filled there
the same way, and handed back down. So no task sorts more than a block, or FAN rows of a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN, LEVELS = 256, 3


def _entering(ends: DataFrame, level: int) -> DataFrame:
    """_b, _in: what enters each block, from the last value (_last, in a struct; null if it has none) of each."""
    if level == 0:  # at most FAN rows are left, for numbers below FAN ** (LEVELS + 1)
        every = ends.agg(F.array_sort(F.collect_list(F.struct("_b", "_last"))).alias("_all"))
        before = F.filter("_all", lambda x: (x["_b"] < F.col("_b")) & x["_last"].isNotNull())
        return ends.crossJoin(F.broadcast(every)).select("_b", F.try_element_at(before, F.lit(-1)).getField("_last").alias("_in"))  # one row
    grouped = ends.withColumn("_up", F.floor(F.col("_b") / FAN).cast("long"))
    above = grouped.groupBy("_up").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_b"))).alias("_last"))
    entered = _entering(above.select(F.col("_up").alias("_b"), "_last"), level - 1).select(F.col("_b").alias("_up"), F.col("_in").alias("_far"))
    near = F.last("_last", ignorenulls=True).over(Window.partitionBy("_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return grouped.withColumn("_near", near).join(entered, "_up", "left").select("_b", F.coalesce("_near", "_far").alias("_in"))


def carried(rows: DataFrame, order: list[str], value: Column, block: Column, name: str) -> DataFrame:
    """rows with `name`: value, where it isn't null, else that of the nearest row before it in `order`; null before the first.

    block: a number from 0 that never falls along the order, such as hours since a start or ordinal // 10,000:
    its rows are what one task sorts. `order` should be total; where rows tie, one of their values is carried.
    """
    held = rows.withColumn("_v", F.when(value.isNotNull(), F.struct(value.alias("x")))).withColumn("_b", block.cast("long"))
    ends = held.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    inside = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = held.withColumn("_own", F.last("_v", ignorenulls=True).over(inside)).join(_entering(ends, LEVELS), "_b", "left")
    return filled.withColumn(name, F.coalesce("_own", "_in")["x"]).drop("_v", "_b", "_own", "_in")
