"""Outbox tables, ordered change feeds and inbox batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_INDEX = 32767
MAX_LSN = (1 << 48) - 1
OPERATIONS = ("insert", "update", "delete")


def read_outbox(outbox: DataFrame, event: str, after: int, limit: int | None = None) -> DataFrame:
    """Rows of one event past the cursor, in id order; a batch job passes no limit."""
    rows = outbox.filter((F.col("event") == event) & (F.col("id") > after)).withColumns(
        {"event_id": F.col("id").cast("string"), "position": F.col("id")}
    )
    return rows if limit is None else rows.orderBy("position").limit(limit)


def oversized_transactions(feed: DataFrame) -> DataFrame:
    """Transactions a position cannot order: too many changes of the table, or a late LSN."""
    counted = feed.groupBy("commit_lsn").agg(F.count(F.lit(1)).alias("changes"))
    return counted.filter((F.col("changes") > MAX_INDEX) | (F.col("commit_lsn") > MAX_LSN))


def change_payload(op: str = "op", new: str = "new", old: str = "old", unchanged: str | None = None) -> Column:
    """The row a change carries: the old one for a delete, else the new one.

    Rows are maps; NULL values stay, large values the log left out (``unchanged`` names
    them) do not.
    """
    row = F.when(F.col(op) == "delete", F.col(old)).otherwise(F.col(new))
    if unchanged is None:
        return row
    left_out = F.coalesce(F.col(unchanged), F.array().cast("array<string>"))
    return F.map_filter(row, lambda k, _: ~F.array_contains(left_out, k))


def read_changes(
    feed: DataFrame, operations: Sequence[str] = OPERATIONS, after: int = 0, limit: int | None = None
) -> DataFrame:
    """Changes of one table in commit order, as (position, event_id, ...).

    The position is the commit's LSN with the change's index inside the transaction; the
    index counts every change of the table, wanted or not. A transaction that a position
    cannot order stops the read with an error (``oversized_transactions`` reports them):
    going on past it would lose its changes. They are counted before any transaction is
    gathered, so no task orders more than MAX_INDEX rows at a time.
    """
    first_lsn = after >> 15
    recent = feed.filter(F.col("commit_lsn") >= first_lsn)
    oversized = oversized_transactions(recent).select("commit_lsn", F.col("changes").alias("_oversized"))
    told = F.concat(F.lit("transaction "), F.col("commit_lsn"), F.lit(" cannot be ordered: "), F.col("_oversized"), F.lit(" changes"))
    lsn = F.when(F.col("_oversized").isNotNull(), F.raise_error(told).cast("bigint")).otherwise(F.col("commit_lsn"))
    sized = recent.join(oversized, "commit_lsn", "left").withColumn("commit_lsn", lsn).drop("_oversized")
    index = F.row_number().over(Window.partitionBy("commit_lsn").orderBy("seq"))
    placed = sized.withColumn("tx_index", index.cast("bigint")).withColumn(
        "position", F.shiftleft("commit_lsn", 15).bitwiseOR(F.col("tx_index"))
    )
    events = placed.filter((F.col("position") > after) & F.col("op").isin(*operations)).withColumn(
        "event_id", F.format_string("%016X.%d", "commit_lsn", "tx_index")
    )
    return events if limit is None else events.orderBy("position").limit(limit)


def read_inbox(inbox: DataFrame, source: str, after: int, limit: int) -> DataFrame:
    """The next batch of a source's inbox, in order of arrival."""
    mine = inbox.filter((F.col("source") == source) & (F.col("seq") > after))
    return mine.orderBy("seq").limit(limit)
