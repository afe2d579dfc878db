"""Incremental reads of polled lists: positions, settle and lookback times, boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000


def newer(items: DataFrame, after: int, settle_ms: int = 0, now_ms: int | None = None) -> DataFrame:
    """Items past the cursor that are old enough to be settled."""
    out = items.filter(F.col("position") > after)
    if settle_ms:
        out = out.filter(F.col("position") <= now_ms - settle_ms)
    return out


def poll(
    items: DataFrame,
    after: int,
    limit: int | None = None,
    versioned: bool = False,
    settle_ms: int = 0,
    now_ms: int | None = None,
) -> DataFrame:
    """The next items in position order, named by id, or by id@position when versioned."""
    out = newer(items, after, settle_ms, now_ms)
    name = F.col("id").cast("string")
    if versioned:
        name = F.concat_ws("@", name, F.col("position").cast("string"))
    out = out.withColumn("event_id", name)
    return out if limit is None else out.orderBy("position", "id").limit(limit)


def boundary(items: DataFrame, limit: int) -> DataFrame:
    """One row: the last position a batch of about ``limit`` may take in whole (``upper``).

    When more items wait, the group sharing the last position is left for the next poll; a
    first group larger than the batch is taken whole (``one_position``), since a strict
    cursor could not come back for its rest. Only ``limit + 1`` positions are looked at.
    """
    page = items.select("position").orderBy("position").limit(limit + 1)
    found = page.agg(F.sort_array(F.collect_list("position")).alias("p"))
    cut = F.size("p") > limit
    last = F.try_element_at("p", F.lit(limit))
    below = F.array_max(F.filter("p", lambda x: x < last))
    return found.select(
        F.when(cut, F.coalesce(below, last)).otherwise(F.array_max("p")).alias("upper"),
        (cut & below.isNull()).alias("one_position"),
    )


def poll_whole_positions(
    items: DataFrame, after: int, limit: int, settle_ms: int = 0, now_ms: int | None = None
) -> DataFrame:
    """A batch that never ends inside a group of items sharing a position.

    The first items up to the boundary; a batch that settle alone cuts short is whole.
    """
    waiting = newer(items, after, settle_ms, now_ms)
    upper = boundary(waiting, limit).select("upper")
    return waiting.filter(F.col("position") <= upper.scalar())


def raise_to_lookback(cursors: DataFrame, now_ms: int, lookback_ms: int) -> DataFrame:
    """Cursors no older than the API's window, and the unread gap where one was raised.

    A minute's margin keeps the request inside the window; a cursor never read has no gap.
    """
    floor = F.lit(now_ms - lookback_ms + MINUTE)
    raised = F.col("position") < floor
    lost = raised & (F.col("position") > 0)
    return cursors.withColumns(
        {
            "gap_from": F.when(lost, F.col("position")),
            "gap_to": F.when(lost, floor),
            "position": F.greatest("position", floor),
        }
    )


def split_filtered(items: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """(items that match, one row with the cursor past everything read).

    Items the filter leaves out start nothing but move the cursor.
    """
    return items.filter(F.coalesce(test, F.lit(False))), items.agg(F.max("position").alias("cursor"))


def composite_position(ts: Column, record_id: Column) -> Column:
    """Seconds and id in one number, so that records of one second are read in id order."""
    return F.shiftleft(F.unix_seconds(ts), 31).bitwiseOR(record_id)


def decode_composite(position: Column) -> Column:
    """struct<seconds, id> of a composite cursor.

    Old cursors were milliseconds, far below any composite position of this century; the
    second they name was read in full, so its id is the largest.
    """
    old = position < F.lit(1 << 50)
    return F.struct(
        F.when(old, F.floor(position / 1000).cast("bigint")).otherwise(F.shiftright(position, 31)).alias("seconds"),
        F.when(old, F.lit((1 << 31) - 1)).otherwise(position.bitwiseAND(F.lit((1 << 31) - 1))).alias("id"),
    )


def parse_position(text: Column, form: str = "number") -> Column:
    """Text as a position: a number, or a time in Unix milliseconds. NULL when unreadable."""
    if form == "msjson":
        return F.regexp_extract(text, r"^/Date\((-?[0-9]+)([+-][0-9]{4})?\)/$", 1).try_cast("bigint")
    if form == "rfc3339":
        dated = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+(Z|[+-][0-9]{2}:[0-9]{2})$")
        return F.unix_millis(F.when(dated, text).try_cast("timestamp"))
    if form == "unix":
        return text.try_cast("bigint") * 1000
    return text.try_cast("bigint")


def format_position(position: Column, form: str = "number") -> Column:
    """The text an API takes for a position."""
    if form == "msjson":
        return F.format_string("/Date(%d+0000)/", position)
    if form == "rfc3339":
        return F.date_format(F.timestamp_millis(position), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if form == "unix":
        return F.floor(position / 1000).cast("string")
    return position.cast("string")


def guard_new(items: DataFrame, after: int, max_new: int) -> DataFrame:
    """Whether a newest-first list was read back to its cursor within ``max_new`` items.

    A set has no page order; only the guard remains: too many new items are an error and
    none of them may be taken.
    """
    new = items.filter(F.col("position") > after).agg(F.count(F.lit(1)).alias("new_items"))
    return new.withColumn("readable", F.col("new_items") <= max_new)


def narrow_window(
    items: DataFrame, after: int, max_items: int, settle_ms: int = 0, now_ms: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items of the newest window an unordered, capped answer can hold, the unread gap).

    A full answer leaves out items it does not name. The cursor moves to the position of
    the ``max_items``-th newest settled item, so fewer than that many are newer; what lies
    between the old and the new cursor is reported as one gap row.
    """
    settled = newer(items, after, settle_ms, now_ms)
    newest = settled.select("position").orderBy(F.desc("position")).limit(max_items)
    found = newest.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("oldest"))
    start = found.select(F.when(F.col("n") >= max_items, F.col("oldest")).otherwise(F.lit(after)).alias("gap_to"))
    gap = start.filter(F.col("gap_to") > after).select(F.lit(after).cast("bigint").alias("gap_from"), "gap_to")
    return settled.filter(F.col("position") > start.scalar()), gap
