"""Streaming intake: events into the inbox exactly once, runs started once, late rows.

What a stream has given out is remembered in its own keyed state, partitioned by the hash of
the identity and kept in RocksDB, by the time of receipt: an event is as welcome when it
comes late as when it comes early, only repeats are dropped, and no batch reads what earlier
ones wrote.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from flowlink.operators import inbox as I
from flowlink.session import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """A query started on what its source has now, with its state in RocksDB.

    The session's own choice of a state store comes back.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, files: str = "*", per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files as they appear in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table holds any batch yet (the path may be on any file system)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def deliver(batch: DataFrame, batch_id: int, inbox: str, order: str = "arrived", retention: int | None = None) -> None:
    """Adds a batch that no stream remembers to the inbox table at a path: each event once.

    The batch goes to a folder of its own, overwritten when the batch is run again, and is
    compared with the identities of the other batches kept (the last ``retention``, where
    older ones have been pruned): neither a repeated batch nor a repeated event is stored
    twice. Streams use ``run_to_inbox``, which doesn't read the inbox.
    """
    spark = batch.sparkSession
    stored = None
    if _exists(spark, inbox):
        earlier = spark.read.option("basePath", inbox).schema("source string, event_id string, batch bigint").parquet(inbox)
        stored = earlier.filter(F.col("batch") != batch_id)
        if retention is not None:
            stored = stored.filter(F.col("batch") >= batch_id - retention)
    new = I.keep_first(batch, stored, order)
    new.write.mode("overwrite").parquet(f"{inbox}/batch={batch_id}")


def run_to_inbox(arrivals: DataFrame, inbox: str, checkpoint: str, order: str = "arrived", retention: str = "7 days") -> None:
    """Runs a stream of arrivals into the inbox until its source is read.

    The checkpoint holds the source's position and the identities received within
    ``retention``, and moves both in one step; a batch is written to a folder of its own, so
    one that is run again after a loss replaces itself. A checkpoint that begins beside an
    inbox that has events already takes their identities over as its first state: that is
    the only time the inbox is read.
    """
    spark = arrivals.sparkSession
    known, first = f"{checkpoint.rstrip('/')}-known", f"{checkpoint.rstrip('/')}-first"
    if not _exists(spark, checkpoint):
        # Folders of an earlier checkpoint stay: this one's batches are numbered after them.
        empty = spark.createDataFrame([], "source string, event_id string, batch bigint")
        stored = read_inbox_table(spark, inbox) if _exists(spark, inbox) else empty
        stored.select(*I.IDENTITY).distinct().write.mode("overwrite").parquet(known)
        stored.agg((F.coalesce(F.max("batch"), F.lit(-1)) + 1).cast("bigint").alias("batch")).write.mode("overwrite").parquet(first)
    offset = spark.read.schema("batch bigint").parquet(first).collect()[0]["batch"]
    identities = read_folder(spark, known, T.StructType().add("source", "string").add("event_id", "string"))
    fresh = once(arrivals, I.IDENTITY, order, retention, identities)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{inbox}/batch={offset + number}")

    started(fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), spark).awaitTermination()


def read_inbox_table(spark: SparkSession, inbox: str) -> DataFrame:
    return spark.read.option("basePath", inbox).parquet(inbox)


HELD_BYTES = 64 << 20  # rows of a batch that a task holds before it puts them aside
PARTS = 64  # by ``_part``, of what was put aside: held one at a time


def _first_of_batch(keys: Sequence[str], order: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a partition that holds all of a batch's rows of its keys, the first row per key.

    Each row is ranked once. What is more than ``HELD_BYTES`` goes to the task's own temporary
    files, as a shuffle's rows do, parted by a hash of the keys (``_part``).
    """

    def least(rows: pa.Table) -> pa.Table:
        ranked = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order], null_placement="at_end")
        named = rows.select(list(keys)).take(ranked).append_column("_at", pa.array(np.arange(rows.num_rows)))
        first = named.group_by(list(keys), use_threads=False).aggregate([("_at", "min")])["_at_min"]
        return rows.take(ranked.take(first))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="flowlink-") as folder:
            held, files = [], {}

            def put_aside() -> None:
                rows = pa.Table.from_batches(held)
                for part in pc.unique(rows["_part"]).to_pylist():
                    if part not in files:
                        files[part] = pa.ipc.new_stream(f"{folder}/{part}", rows.schema)
                    files[part].write_table(rows.filter(pc.equal(rows["_part"], part)))
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(b.nbytes for b in held) >= HELD_BYTES:
                    put_aside()
            if held and files:
                put_aside()
            if held:
                yield from least(pa.Table.from_batches(held)).to_batches()
            for part, file in files.items():
                file.close()
                with pa.OSFile(f"{folder}/{part}") as kept, pa.ipc.open_stream(kept) as rows:
                    yield from least(rows.read_all()).to_batches()

    return firsts


def once(
    arrivals: DataFrame, keys: Sequence[str], order: str, retention: str = "7 days", known: DataFrame | None = None
) -> DataFrame:
    """A stream's first arrival per key, remembered for ``retention`` after its receipt.

    The watermark runs over the time of receipt, which no row can be behind: no arrival is
    too late to be given out, whatever times it carries, and a key is forgotten when its
    receipt is older than ``retention``, as the inbox is pruned. Of the rows of a key that
    one batch holds the first by ``order`` counts (rows without one come last, equal ones
    are told apart by their hash). ``known`` is a stream of keys that have been given out
    already; it wins over arrivals of its batch. A task holds a bounded
    part of a batch's rows at a time.
    """
    keys = list(keys)
    plain = [f.name for f in arrivals.schema.fields if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
    rows = arrivals.withColumns({"_tie": F.xxhash64(*plain), "_known": F.lit(0), "_part": F.pmod(F.xxhash64(*keys), F.lit(PARTS))})
    if known is not None:
        absent = {f.name: F.lit(None).cast(f.dataType) for f in arrivals.schema.fields if f.name not in keys}
        rows = rows.unionByName(known.select(*keys).withColumns(absent | {"_tie": F.lit(0).cast("bigint"), "_known": F.lit(-1), "_part": F.pmod(F.xxhash64(*keys), F.lit(PARTS))}))
    parts = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = rows.repartition(parts, *keys).mapInArrow(_first_of_batch(keys, ["_known", order, "_tie"]), rows.schema)
    timed = first.withColumn("_received", F.current_timestamp()).withWatermark("_received", retention)
    return timed.dropDuplicatesWithinWatermark(keys).filter("_known = 0").select(*arrivals.columns)


def start_runs(events: DataFrame, workflow: Column, order: str, retention: str = "7 days") -> DataFrame:
    """A stream's events with their run: one run per (workflow, event id).

    Runs started are remembered for the inbox's ``retention`` from their events' receipt,
    after which the inbox no longer gives those out. An event that comes late starts its run
    late.
    """
    named = events.withColumn("workflow", workflow)
    named = named.withColumn("run_id", F.concat_ws("/", "workflow", F.col("event_id").cast("string")))
    return once(named, ["workflow", "event_id"], order, retention)


def settled(events: DataFrame, at: str, delay: str, keys: list[str], width: str) -> DataFrame:
    """Events counted per window once the window is older than the settle delay.

    The watermark plays the settle time: a window is given out only when no event of it
    can still be waiting.
    """
    return events.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("events"))


def reconcile(push: DataFrame, polled: DataFrame) -> DataFrame:
    """A push stream and a poll of the same source in one stream, for one inbox."""
    return I.union_arrivals(push, polled)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream into a Parquet table until its source is read."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path)
    started(writer.option("checkpointLocation", checkpoint), stream.sparkSession).awaitTermination()


def resume(
    rows: Callable[[str], DataFrame], inbox: str, checkpoint: str | None, fresh: str, order: str = "arrived"
) -> None:
    """Goes on after a loss of the source's position: from the earliest event kept.

    ``rows`` gives the source's stream from a starting point ("stored" or "earliest").
    With the old checkpoint gone a fresh one starts at the earliest; the inbox drops what
    it knows.
    """
    if checkpoint is not None and _exists(rows("stored").sparkSession, checkpoint):
        run_to_inbox(rows("stored"), inbox, checkpoint, order)
    else:
        run_to_inbox(rows("earliest"), inbox, fresh, order)
