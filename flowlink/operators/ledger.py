"""The write ledger and sinks: idempotent writes, keyed tables, undo plans, row pushes.

Tables are never changed in place: an operator returns the new table state, or the change
set, and the caller writes it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.operators.inbox import first_by

LEASE_MINUTES = 5
MAX_GENERATIONS = 50
BATCH_ROWS = 10_000
COMPENSATE = "#compensate"
REVERSED = "#reversed"


def store_key(target: Column, operation: Column, key: Column) -> Column:
    """target/operation/key, NULL if a part is: what has no whole key shares none."""
    return F.concat(target, F.lit("/"), operation, F.lit("/"), key)


def split_requests(requests: DataFrame, ledger: DataFrame, now_minute: int, order: str, lease: int = LEASE_MINUTES) -> DataFrame:
    """Requests with what the ledger says: duplicate, blocked, write or invalid.

    ``requests`` has a store ``key``; ``ledger`` is (key, status, claimed_minute). A done
    write is a duplicate, a claim younger than the lease blocks, an older one is taken over.
    Of several requests with one key the first by ``order`` writes. A request without a key
    is invalid: it is neither written nor taken for another one's copy.

    Statuses are found per key, so copies of one request are combined before the shuffle.
    """
    keyless = requests.filter(F.col("key").isNull()).withColumn("ledger_state", F.lit("invalid"))
    requests = requests.filter(F.col("key").isNotNull())
    winners = requests.groupBy("key").agg(F.min(order).alias("_first"))
    known = winners.join(ledger.select("key", "status", "claimed_minute"), "key", "left")
    held = F.lit(now_minute) - F.col("claimed_minute") <= lease
    per_key = known.select(
        "key", "_first",
        F.when(F.col("status") == "done", "duplicate").when((F.col("status") == "inflight") & held, "blocked").alias("_state"),
    )
    state = F.coalesce("_state", F.when(F.col(order) == F.col("_first"), "write").otherwise("duplicate"))
    found = requests.join(per_key, "key").withColumn("ledger_state", state).drop("_first", "_state")
    return found.unionByName(keyless)


def complete(ledger: DataFrame, written: DataFrame, now_minute: int) -> DataFrame:
    """The ledger after writes (key, succeeded): done, or the claim released."""
    after = written.select("key", "succeeded")
    kept = ledger.select("key", "status", "claimed_minute").join(after.select("key"), "key", "left_anti")
    done = after.filter("succeeded").select("key", F.lit("done").alias("status"), F.lit(now_minute).cast("int").alias("claimed_minute"))
    return kept.unionByName(done)


# --- Keyed tables -----------------------------------------------------------------------


def insert_absent(table: DataFrame, rows: DataFrame, key: str, defaults: Mapping[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to add, row returned per key: the stored one, or the new one).

    Columns a row does not bring take their defaults. Of several rows with one key the
    lowest by its values is added.
    """
    defaults = defaults or {}
    full = rows.select(
        *[
            F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in rows.columns and c in defaults
            else F.col(c) if c in rows.columns
            else F.lit(defaults.get(c)).cast(table.schema[c].dataType).alias(c)
            for c in table.columns
        ]
    )
    rest = [c for c in table.columns if c != key]
    one = first_by(full, [key], F.struct(*rest))
    added = one.join(table.select(key), key, "left_anti").select(*table.columns)
    stored = table.join(one.select(key), key, "left_semi").select(*table.columns)
    return added, stored.withColumn("inserted", F.lit(False)).unionByName(added.withColumn("inserted", F.lit(True)))


class Update(NamedTuple):
    """The new table, changed rows with both images, and rows whose key is unknown."""

    table: DataFrame
    changes: DataFrame
    unknown: DataFrame


def update_by_key(table: DataFrame, updates: DataFrame, key: str, fixed: Mapping[str, object] | None = None) -> Update:
    """Rows updated by key with the columns ``updates`` brings, then the fixed values.

    ``updates`` has one row per key; bring several to one with ``first_by`` first.
    ``changes`` holds (key, previous, applied) for ``restore``: what a write replaced.
    """
    fixed = fixed or {}
    columns = [c for c in updates.columns if c != key and c not in fixed]
    brought = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(brought, key, "left")
    hit = F.col("_hit").isNotNull()

    def after(c: str) -> Column:
        if c in fixed:
            return F.when(hit, F.lit(fixed[c]).cast(table.schema[c].dataType)).otherwise(F.col(c))
        if c in columns:
            return F.when(hit, F.col(f"_new_{c}").cast(table.schema[c].dataType)).otherwise(F.col(c))
        return F.col(c)

    touched = [c for c in table.columns if c in columns or c in fixed]
    new = joined.select(*[after(c).alias(c) for c in table.columns])
    changes = joined.filter(hit).select(
        key, F.struct(*touched).alias("previous"), F.struct(*[after(c).alias(c) for c in touched]).alias("applied")
    )
    return Update(new, changes, updates.join(table.select(key), key, "left_anti"))


def restore(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the previous values of a captured update sent back."""
    return update_by_key(table, changes.select(key, "previous.*"), key).table


def delete_by_key(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows deleted)."""
    wanted = keys.select(key)
    return table.join(wanted, key, "left_anti"), table.join(wanted, key, "left_semi")


def read_by_key(table: DataFrame, keys: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of the rows with the given keys."""
    return table.select(key, *[c for c in columns if c != key]).join(keys.select(key), key, "left_semi")


def preview(changes: DataFrame, current: str = "previous", proposed: str = "applied") -> DataFrame:
    """A dry run: what a write would change, as JSON of the current and proposed values."""
    return changes.withColumns({"current": F.to_json(current), "proposed": F.to_json(proposed)}).drop(current, proposed)


def unconfirmed(written: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Written keys the target does not show on reading back; they stay committed."""
    return written.join(target.select(key), key, "left_anti")


# --- Undo -------------------------------------------------------------------------------


def generations(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds generation, write_key and write_error: a write undone n times is written anew as key~n+1.

    ``requests`` has target, compensation and idempotency_key; a compensation is committed
    when the ledger holds its key as done. A write undone in all ``MAX_GENERATIONS`` - 1
    generations, and one without a key, gets no write_key but says why in ``write_error``;
    ``split_requests`` calls it invalid.
    """
    undo = ledger.filter((F.col("status") == "done") & F.col("key").endswith(COMPENSATE)).select(
        F.expr(f"left(key, length(key) - {len(COMPENSATE)})").alias("_whole")
    )
    # A key may itself end in ~n, so each entry is read both ways.
    number = F.regexp_extract("_whole", r"~([0-9]{1,2})$", 1).try_cast("int")
    ways = F.array_compact(
        F.array(
            F.struct(F.col("_whole").alias("_base"), F.lit(1).alias("_n")),
            F.when(number.between(2, MAX_GENERATIONS), F.struct(F.regexp_replace("_whole", r"~[0-9]{1,2}$", "").alias("_base"), number.alias("_n"))),
        )
    )
    # A bit per generation done, in one number. The list is as long as the ledger, however small
    # the tables it was made from looked: it is never broadcast.
    done = undo.select(F.inline(ways)).groupBy("_base").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_n"))).alias("_done"))
    keyed = requests.withColumn("_base", store_key(F.col("target"), F.col("compensation"), F.col("idempotency_key")))
    # The lowest bit not set from 1 on: bit 0 is no generation.
    lowest = F.coalesce("_done", F.lit(0)).bitwiseOR(F.lit(1))
    free = F.bit_count(lowest.bitwiseAND(F.bitwise_not(lowest + 1))).cast("int")
    out = keyed.join(done.hint("merge"), "_base", "left").withColumn("generation", F.when(free < MAX_GENERATIONS, free))
    key = F.when(F.col("generation") == 1, F.col("idempotency_key")).otherwise(
        F.concat(F.col("idempotency_key"), F.lit("~"), F.col("generation").cast("string"))
    )
    error = F.when(F.col("idempotency_key").isNull(), "the write has no idempotency key").when(
        F.col("generation").isNull(), f"undone {MAX_GENERATIONS - 1} times: the write needs another idempotency key"
    )
    return out.withColumns({"write_key": key, "write_error": error}).drop("_base", "_done")


def undo_plan(writes: DataFrame, failed_runs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Compensations of failed runs' committed writes, last step first.

    ``writes`` is (run_id, step, target, compensation, idempotency_key, status); duplicates
    are another run's to undo, and compensations the ledger holds already are dropped.
    Writes without a compensation are listed as not undone.
    """
    committed = writes.filter(F.col("status") == "committed").join(failed_runs.select("run_id"), "run_id", "left_semi")
    keyed = committed.withColumn(
        "key", F.concat(store_key(F.col("target"), F.col("compensation"), F.col("idempotency_key")), F.lit(COMPENSATE))
    )
    open_ = keyed.join(ledger.filter(F.col("status") == "done").select("key"), "key", "left_anti")
    order = Window.partitionBy("run_id").orderBy(F.desc("step"))
    return open_.withColumn("undo_order", F.row_number().over(order)).withColumn(
        "action", F.when(F.col("compensation").isNull(), "not undone").otherwise("undo")
    )


# --- Row pushes -------------------------------------------------------------------------


def push_rows(payloads: DataFrame, rows: str, key: str, row_key: str) -> DataFrame:
    """One row per element of each payload's array, keyed and numbered into batches.

    A single row takes the payload's key, several take key/1, key/2 and so on.
    """
    listed = payloads.withColumn("_count", F.size(rows)).select(key, "_count", F.posexplode(rows).alias("_i", "_row"))
    name = F.when(F.col("_count") == 1, F.col(key)).otherwise(F.concat_ws("/", key, (F.col("_i") + 1).cast("string")))
    return listed.select(
        key, "_row.*", name.alias(row_key), F.floor(F.col("_i") / BATCH_ROWS).cast("int").alias("batch")
    )


def reverse_rows(pushed: DataFrame, negate: Sequence[str], fixed: Mapping[str, object], row_key: str) -> DataFrame:
    """Pushed rows with measures negated, so that sums return to what they were."""
    out = pushed.withColumns({c: -F.col(c) for c in negate})
    out = out.withColumns({c: F.lit(v) for c, v in fixed.items()})
    return out.withColumn(row_key, F.concat(F.col(row_key), F.lit(REVERSED)))


def write_batches(rows: DataFrame, send) -> None:
    """Sends rows to a service in batches of ``BATCH_ROWS``, from the tasks that hold them.

    ``send`` takes a list of rows and must be idempotent by row key: a lost task runs again.
    """

    def push(partition) -> None:
        batch = []
        for row in partition:
            batch.append(row)
            if len(batch) == BATCH_ROWS:
                send(batch)
                batch = []
        if batch:
            send(batch)

    rows.foreachPartition(push)
