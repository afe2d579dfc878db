"""Ordered computations over a whole table without ordering it in one task.

A number orders the rows (unique, such as a log position). Rows are cut into blocks by it;
windows run inside blocks, and one summary row per block carries what a later block needs.
Blocks are as wide as the numbers are sparse, so that they hold some ten thousand rows each
whether numbers are consecutive or far apart, and summaries are summed up in as many levels
as leave no task more than some thousand of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.session import stored

BLOCK_ROWS = 1 << 16  # rows a block holds, about
LEVEL_BITS = 12  # summaries of a group: as many as have equal higher bits


class Cut(NamedTuple):
    """How a table's order is cut: the lowest number, a block's width, levels of summaries."""

    low: int
    bits: int
    levels: int

    def block(self, order: str) -> Column:
        return F.shiftright(F.col(order) - F.lit(self.low), self.bits)


def cut_of(df: DataFrame, order: str) -> Cut:
    """The cut that suits a table; its order column alone is read for it."""
    found = df.agg(F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).collect()[0]
    if not found["n"]:
        return Cut(0, 0, 0)
    low, span = int(found["low"]), int(found["high"]) - int(found["low"]) + 1
    bits = max(0, (span // max(1, found["n"] // BLOCK_ROWS)).bit_length() - 1)
    blocks, levels = (span >> bits) + 1, 0
    while blocks >> (LEVEL_BITS * (levels + 1)):
        levels += 1
    return Cut(low, bits, levels)


def _last_before(summary: DataFrame, keys: Sequence[str], value: str, place: str, levels: int) -> DataFrame:
    """(keys, place, _carry): the last non-NULL value of any earlier place, group by group."""
    if not levels:
        window = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(*keys, place, F.last(value, ignorenulls=True).over(window).alias("_carry"))
    group = f"_group{levels}"
    grouped = summary.select(*keys, place, F.col(value).alias("_v"), F.shiftright(place, LEVEL_BITS).alias(group))
    window = Window.partitionBy(*keys, group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    near = grouped.withColumn("_near", F.last("_v", ignorenulls=True).over(window))
    last = grouped.groupBy(*keys, group).agg(F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.col(place))).alias("_v"))
    far = _last_before(last, keys, "_v", group, levels - 1).withColumnRenamed("_carry", "_far")
    return near.join(far, [*keys, group]).select(*keys, place, F.coalesce("_near", "_far").alias("_carry"))


def _sum_before(summary: DataFrame, keys: Sequence[str], place: str, levels: int) -> DataFrame:
    """(keys, place, _carry): the sum of ``_sum`` over all earlier places, group by group."""
    if not levels:
        window = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(*keys, place, F.coalesce(F.sum("_sum").over(window), F.lit(0)).alias("_carry"))
    group = f"_group{levels}"
    grouped = summary.withColumn(group, F.shiftright(place, LEVEL_BITS))
    window = Window.partitionBy(*keys, group).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    near = grouped.withColumn("_near", F.coalesce(F.sum("_sum").over(window), F.lit(0)))
    far = _sum_before(grouped.groupBy(*keys, group).agg(F.sum("_sum").alias("_sum")), keys, group, levels - 1).withColumnRenamed("_carry", "_far")
    return near.join(far, [*keys, group]).select(*keys, place, (F.col("_near") + F.col("_far")).alias("_carry"))


def carried(df: DataFrame, order: str, value: str, into: str, keys: Sequence[str] = ()) -> DataFrame:
    """``into``: the last non-NULL ``value`` at or before each row, in ``order`` per key."""
    how = cut_of(df, order)
    cut = df.withColumn("_block", how.block(order))
    window = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_here", F.last(value, ignorenulls=True).over(window))
    summary = cut.groupBy(*keys, "_block").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("_value")
    )
    before = _last_before(summary, keys, "_value", "_block", how.levels)
    joined = local.join(before, [*keys, "_block"], "left")
    return joined.withColumn(into, F.coalesce("_here", "_carry")).drop("_block", "_here", "_carry")


def previous_row(df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``prev_<column>`` of the row before, and ``has_prev``, in ``order`` per key."""
    how = cut_of(df, order)
    cut = df.withColumn("_block", how.block(order)).withColumn("_row", F.struct(*columns))
    window = Window.partitionBy(*keys, "_block").orderBy(order)
    local = cut.withColumn("_prev", F.lag("_row").over(window))
    summary = cut.groupBy(*keys, "_block").agg(F.max_by("_row", order).alias("_value"))
    before = _last_before(summary, keys, "_value", "_block", how.levels)
    joined = local.join(before, [*keys, "_block"], "left").withColumn("_prev", F.coalesce("_prev", "_carry"))
    out = joined.withColumn("has_prev", F.col("_prev").isNotNull())
    return out.withColumns({f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_block", "_row", "_prev", "_carry")


def running_sum(df: DataFrame, order: str, value: str, into: str, keys: Sequence[str] = ()) -> DataFrame:
    """``into``: the sum of ``value`` up to and including each row, in ``order`` per key."""
    how = cut_of(df, order)
    cut = df.withColumn("_block", how.block(order))
    window = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_here", F.sum(value).over(window))
    summary = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = _sum_before(summary, keys, "_block", how.levels)
    joined = local.join(before, [*keys, "_block"], "left")
    return joined.withColumn(into, F.col("_here") + F.col("_carry")).drop("_block", "_here", "_carry")


def run_starts(df: DataFrame, order: str, columns: Sequence[str], into: str, keys: Sequence[str] = ()) -> DataFrame:
    """``into``: the order of the first row of each row's run, per key.

    A run is rows following each other in ``order`` with equal ``columns`` (NULL equals
    NULL). Blocks find their own runs; one row per block, written once, says how it begins
    and ends, which tells the runs that go on from one block into the next. The input is
    read twice, however long a run is.
    """
    how = cut_of(df, order)
    cut = df.withColumn("_block", how.block(order)).withColumn("_row", F.struct(*columns))
    window = Window.partitionBy(*keys, "_block").orderBy(order)
    begins = F.lag(order).over(window).isNull() | ~F.col("_row").eqNullSafe(F.lag("_row").over(window))
    marked = cut.withColumn("_begin", F.when(begins, F.col(order)))
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_start", F.last("_begin", ignorenulls=True).over(so_far))
    summary = local.groupBy(*keys, "_block").agg(
        F.min(order).alias("_opens"), F.max("_start").alias("_last"), F.min_by("_row", order).alias("_head"), F.max_by("_row", order).alias("_tail")
    )
    summary = stored(summary, "runs")
    tails = _last_before(summary, keys, "_tail", "_block", how.levels).withColumnRenamed("_carry", "_before")
    on = [*keys, "_block"]
    joined = summary.join(tails, on, "left")
    goes_on = F.col("_before").isNotNull() & F.col("_head").eqNullSafe(F.col("_before"))
    # A block that is all one run, gone on with, doesn't say where that began: an earlier one does.
    ends = stored(joined.withColumn("_goes_on", goes_on).withColumn(
        "_said", F.when(~(F.col("_goes_on") & (F.col("_last") == F.col("_opens"))), F.col("_last"))
    ).select(*on, "_opens", "_goes_on", "_said"), "runs")
    carried_over = _last_before(ends, keys, "_said", "_block", how.levels).join(ends.filter("_goes_on").select(*on, "_opens"), on)
    out = local.join(carried_over, on, "left")
    start = F.when(F.col("_start") == F.col("_opens"), F.col("_carry")).otherwise(F.col("_start"))
    return out.withColumn(into, start).select(*df.columns, into)
