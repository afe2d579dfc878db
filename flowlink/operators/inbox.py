"""The inbox: every event once, however often and on whichever way it arrives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("source", "event_id")


FIXED_WIDTH = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def first_by(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``; rows without an order come last.

    Equal orders are told apart by a hash of the row, so the choice depends on the rows
    alone. The best order of each key is a hash aggregate of fixed-width numbers, combined
    before the shuffle; the rows are joined back to it and only those that hold it are
    looked at further. An order of texts or structs can't be aggregated so: its rows are
    ranked, and Spark keeps one per key and task before the shuffle.
    """
    marked = df.withColumn("_order", order)
    plain = [f.name for f in df.schema.fields if f.name not in keys and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    tie = F.xxhash64(*keys, *plain)
    first = F.col("_order").desc_nulls_last() if last else F.col("_order").asc_nulls_last()
    if isinstance(marked.schema["_order"].dataType, FIXED_WIDTH):
        best = F.max("_order") if last else F.min("_order")
        bests = marked.groupBy(*keys).agg(best.alias("_best"))
        same = F.col("_order").eqNullSafe(F.col("_best"))
        for k in keys:
            same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}"))
        joined = marked.alias("m").join(bests.alias("b"), same)
        marked = joined.select("m.*")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(first, tie))
    return marked.withColumn("_rank", rank).filter(F.col("_rank") == 1).select(*df.columns)


def keep_first(arrivals: DataFrame, stored: DataFrame | None = None, order: str = "arrived") -> DataFrame:
    """Arrivals to add to the inbox: each (source, event_id) once, none already stored."""
    once = first_by(arrivals, IDENTITY, F.col(order))
    return once if stored is None else once.join(stored.select(*IDENTITY), list(IDENTITY), "left_anti")


def union_arrivals(*streams: DataFrame) -> DataFrame:
    """Webhook, poll and subscription arrivals in one shape."""
    out = streams[0]
    for other in streams[1:]:
        out = out.unionByName(other)
    return out


def new_per_source(new: DataFrame) -> DataFrame:
    """How many events were new, per source."""
    return new.groupBy("source").agg(F.count(F.lit(1)).alias("added"))


def advance_cursors(cursors: DataFrame, read: DataFrame) -> DataFrame:
    """Cursors (name, position) after a read; they only move forward."""
    both = cursors.select("name", "position").unionByName(read.select("name", "position"))
    return both.groupBy("name").agg(F.max("position").alias("position"))


def prune(inbox: DataFrame, before: Column) -> DataFrame:
    """The inbox without deliveries received before a time."""
    return inbox.filter(F.col("received_at") >= before)


def write_inbox(new: DataFrame, table: str, buckets: int = 512) -> None:
    """Appends to the inbox table, bucketed by identity.

    Buckets let the next ``keep_first`` read the stored side without shuffling it.
    """
    new.write.mode("append").bucketBy(buckets, *IDENTITY).sortBy(*IDENTITY).saveAsTable(table)
