"""Streaming queries: each runs its stream to the end and reads what it wrote."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from flowlink.plans import changes as CH
from flowlink.plans import reports as RP
from flowlink.plans.registry import query
from flowlink.session import scratch
from flowlink.sources import change_topic as C
from flowlink.sources import polling as P
from flowlink.streaming import approvals as A
from flowlink.streaming import intake as S


def event_stream(t):
    """The events table as a stream."""
    return S.read_folder(t.spark, t.folder, t["events"].schema, "events.parquet")


def written(t, df, name: str, files: int = 4) -> str:
    """A table written to the shared folder in several files, to be streamed from."""
    path = scratch(t.spark, name)
    df.repartition(files).write.parquet(path)
    return path


STATE_PARTS = 8  # of these examples' streams, on any master


PART_ROWS = 1 << 19  # messages that a task sorts by key in memory: more are dealt to more parts


def run(t, stream, out: str, checkpoint: str, parts: int = STATE_PARTS) -> None:
    """Runs a stream into a table."""
    with few_parts(t, parts):
        S.to_table(stream, out, checkpoint)


@contextlib.contextmanager
def few_parts(t, parts: int = STATE_PARTS):
    """State is kept in as many parts as a stream's first run has; the session's number comes back."""
    conf, name = t.spark.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(parts))
    try:
        yield
    finally:
        conf.set(name, before)


def to_inbox(t, stream, inbox: str, checkpoint: str) -> None:
    with few_parts(t):
        S.run_to_inbox(stream, inbox, checkpoint)


def arrivals_stream(t, per_batch: int = 1):
    """Arrivals, redeliveries included, a file at a time."""
    path = written(t, t["arrivals"], "arrivals")
    return S.read_folder(t.spark, path, t["arrivals"].schema, per_batch=per_batch)


_ONCE = "SELECT DISTINCT source, event_id FROM {arrivals}"


@query("t01_exactly_once_intake", _ONCE)
def _(t):
    inbox, checkpoint = scratch(t.spark, "inbox"), scratch(t.spark, "checkpoint")
    to_inbox(t, arrivals_stream(t), inbox, checkpoint)
    return S.read_inbox_table(t.spark, inbox).select("source", "event_id")


@query(
    "t01_change_stream_to_inbox",
    "SELECT count(*) AS events, count(*) AS ids FROM (SELECT DISTINCT id, code FROM {topic_truth} WHERE state = 'ok' AND code <> 'r')",
)
def _(t):
    topic = CH.topic(t)
    path = written(t, topic, "topic")
    stream = S.read_folder(t.spark, path, topic.schema, per_batch=2)
    events = C.build_events(C.decode(stream, CH.ROW)).select(
        F.lit("orders").alias("source"), C.change_id().alias("event_id"), F.to_json("payload").alias("payload"), F.col("offset").alias("arrived")
    )
    inbox, checkpoint = scratch(t.spark, "inbox"), scratch(t.spark, "checkpoint")
    to_inbox(t, events, inbox, checkpoint)
    return S.read_inbox_table(t.spark, inbox).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_id").alias("ids"))


@query("t02_one_run_per_event", "SELECT event_id, concat(event_type, '/', cast(event_id as varchar)) AS run_id FROM {events}")
def _(t):
    timed = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = timed.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out, checkpoint = scratch(t.spark, "runs"), scratch(t.spark, "checkpoint")
    run(t, S.start_runs(twice, F.col("event_type"), "ts").select("event_id", "run_id"), out, checkpoint)
    return t.spark.read.parquet(out)


@query("t02_late_events_start_runs", "SELECT event_id, concat(event_type, '/', cast(event_id as varchar)) AS run_id FROM {events}")
def _(t):
    # The newest week comes first, each batch is a week older than the one before, and the first
    # week's repeats come last. What is remembered for a day of receipts knows them all.
    timed = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    path, week = scratch(t.spark, "late"), F.floor(F.unix_seconds("ts") / (7 * 86_400))
    marked = timed.withColumn("week", week)
    first, last = marked.agg(F.min("week"), F.max("week")).first()
    for number in [*range(last, first - 1, -1), last]:
        marked.filter(F.col("week") == number).drop("week").coalesce(1).write.mode("append").parquet(path)
    stream = S.read_folder(t.spark, path, timed.schema, per_batch=1)
    out, checkpoint = scratch(t.spark, "runs"), scratch(t.spark, "checkpoint")
    run(t, S.start_runs(stream, F.col("event_type"), "ts", "1 day").select("event_id", "run_id"), out, checkpoint)
    return t.spark.read.parquet(out)


@query("t03_reconcile", "SELECT source, event_id, CASE WHEN cast(event_id as bigint) % 3 = 0 THEN 'poll' ELSE 'webhook' END AS via FROM (SELECT DISTINCT source, event_id FROM {arrivals})")
def _(t):
    # Each third webhook was lost; the poll has everything, later.
    push = t["arrivals"].filter("via = 'poll' AND cast(event_id as bigint) % 3 <> 0").withColumn("via", F.lit("webhook"))
    polled = t["arrivals"].filter("via = 'poll'").withColumn("arrived", F.col("arrived") + 100000000)
    streams = [S.read_folder(t.spark, written(t, df, "arrivals"), df.schema) for df in (push, polled)]
    inbox, checkpoint = scratch(t.spark, "inbox"), scratch(t.spark, "checkpoint")
    to_inbox(t, S.reconcile(*streams), inbox, checkpoint)
    return S.read_inbox_table(t.spark, inbox).select("source", "event_id", "via")


@query(
    "t04_settled_windows",
    """
    SELECT epoch_ms(ts) // 3600000 * 3600000 AS window_ms, event_type, count(*) AS events FROM {events}
    WHERE epoch_ms(ts) // 3600000 * 3600000 + 3600000 <= (SELECT max(epoch_ms(ts)) FROM {events}) - 10800000 GROUP BY 1, 2
    """,
)
def _(t):
    events = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint = scratch(t.spark, "windows"), scratch(t.spark, "checkpoint")
    counted = S.settled(events, "ts", "3 hours", ["event_type"], "1 hour")
    run(t, counted.select(F.unix_millis("window.start").alias("window_ms"), "event_type", "events"), out, checkpoint)
    return t.spark.read.parquet(out)


@query("t04_once_within_retention", "SELECT event_id FROM {events}")
def _(t):
    events = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.col("ts") + F.expr("INTERVAL 1 HOUR") * (F.col("event_id") % 20)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.when(F.col("copy") == 1, late).otherwise(F.col("ts")))
    out, checkpoint = scratch(t.spark, "once"), scratch(t.spark, "checkpoint")
    run(t, S.once(twice, ["event_id"], "at", "7 days").select("event_id"), out, checkpoint)
    return t.spark.read.parquet(out)


@query(
    "t05_await_decisions",
    f"SELECT run_id, status, decided_by, wait_ms FROM ({RP._DECIDED.replace(str(RP.CLOCK), str(4 * 10**12))})",
)
def _(t):
    r = t["approval_requests"].select("run_id", F.lit("request").alias("kind"), "step", "digest", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("actor"), F.col("asked_ms").alias("at_ms"))
    s = t["approval_signals"].select("run_id", F.lit("signal").alias("kind"), "step", "digest", "status", "actor", "at_ms")
    # As they are read, without a shuffle, and packed as digests can be: no file for each read part, as all are one batch.
    first = scratch(t.spark, "messages")
    r.unionByName(s).coalesce(STATE_PARTS).write.option("compression", "zstd").parquet(first)
    parts = max(STATE_PARTS, t.spark.read.parquet(first).count() // PART_ROWS)
    # A last message far in the future lets every request's time run out.
    end = t["orders"].select((F.max("o_orderkey") + 1).alias("run_id")).select(
        "run_id", F.lit("signal").alias("kind"), F.lit(0).alias("step"), F.lit("").alias("digest"), F.lit("").alias("status"), F.lit("").alias("actor"), F.lit(4 * 10**12).alias("at_ms")
    )
    end.write.mode("append").parquet(first)
    schema = r.unionByName(s).schema
    stream = S.read_folder(t.spark, first, schema, per_batch=STATE_PARTS)
    out, checkpoint = scratch(t.spark, "decisions"), scratch(t.spark, "checkpoint")
    run(t, A.await_decisions(stream, RP.TIMEOUT), out, checkpoint, parts)
    return t.spark.read.schema(A.DECISION).parquet(out)


def request_log(t):
    """Runs opening and closing requests for the write of their user."""
    key = F.col("event_id")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return t["events"].select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("key"), key.alias("seq"),
        F.concat(F.lit("r"), (key % 5).cast("string")).alias("run"), F.when(key % 3 == 2, "close").otherwise("open").alias("kind"),
        at.alias("at_ms"), F.when(key % 3 != 2, at + 7 * 86_400_000).alias("until"),
    )


# One message of every key per step: the state is the holder, its time, and the waiters.
_REPLAY = """
    WITH RECURSIVE log AS (
      SELECT concat('w', cast(user_id as varchar)) AS key, event_id AS seq, concat('r', cast(event_id % 5 as varchar)) AS run,
        CASE WHEN event_id % 3 = 2 THEN 'close' ELSE 'open' END AS kind, epoch_ms(ts) AS at, CASE WHEN event_id % 3 <> 2 THEN epoch_ms(ts) + 604800000 END AS until,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {events}
    ), step(key, n, seq, run, kind, holder, waiters, h, u, w) AS (
      SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, '', NULL::VARCHAR, NULL::BIGINT, CAST([] AS VARCHAR[]) FROM log
      UNION ALL
      SELECT l.key, l.n, l.seq, l.run, l.kind,
        CASE WHEN l.kind = 'open' AND h IS NOT NULL AND h <> l.run AND u > l.at THEN h END,
        CASE WHEN l.kind = 'close' AND h = l.run THEN array_to_string(w, ',') ELSE '' END,
        CASE WHEN l.kind = 'open' THEN CASE WHEN h IS NULL OR h = l.run OR u <= l.at THEN l.run ELSE h END WHEN h = l.run THEN NULL ELSE h END,
        CASE WHEN l.kind = 'open' THEN CASE WHEN h IS NULL OR h = l.run OR u <= l.at THEN l.until ELSE u END WHEN h = l.run THEN NULL ELSE u END,
        CASE WHEN h IS NULL OR (l.kind = 'close' AND h = l.run) THEN CAST([] AS VARCHAR[])
             WHEN l.kind = 'close' OR h = l.run OR u <= l.at THEN list_filter(w, lambda x: x <> l.run)
             ELSE list_append(list_filter(w, lambda x: x <> l.run), l.run) END
      FROM step s JOIN log l ON l.key = s.key AND l.n = s.n + 1
    )
    SELECT key, seq, run, kind, holder, waiters FROM step WHERE n > 0
"""


@query("t06_open_requests", _REPLAY)
def _(t):
    return A.replay_requests(request_log(t))


@query("t06_open_requests_stream", _REPLAY)
def _(t):
    log = request_log(t)
    # Files follow the log's order, so that each trigger goes on where the last one ended.
    path = scratch(t.spark, "log")
    log.repartitionByRange(3, "seq").write.parquet(path)
    stream = S.read_folder(t.spark, path, log.schema)
    out, checkpoint = scratch(t.spark, "answers"), scratch(t.spark, "checkpoint")
    run(t, A.open_requests(stream), out, checkpoint)
    return t.spark.read.schema(A.ANSWER).parquet(out)


@query("t08_resume_after_loss", _ONCE)
def _(t):
    path = written(t, t["arrivals"], "arrivals")
    inbox, lost = scratch(t.spark, "inbox"), scratch(t.spark, "checkpoint")
    half = t["arrivals"].filter("user_id % 2 = 0")
    to_inbox(t, S.read_folder(t.spark, written(t, half, "half"), half.schema), inbox, scratch(t.spark, "checkpoint"))
    # The position is gone: everything kept is read again beside the inbox as it is.
    with few_parts(t):
        S.resume(lambda _: S.read_folder(t.spark, path, t["arrivals"].schema, per_batch=2), inbox, lost, scratch(t.spark, "checkpoint"))
    return S.read_inbox_table(t.spark, inbox).select("source", "event_id")


@query("t08_resume_from_stored_position", _ONCE)
def _(t):
    # Two files are read, then the stream is stopped; two more come, and it goes on from its checkpoint.
    path, inbox, checkpoint = written(t, t["arrivals"].filter("user_id % 2 = 0"), "arrivals", 2), scratch(t.spark, "inbox"), scratch(t.spark, "checkpoint")
    rows = lambda start: S.read_folder(t.spark, path, t["arrivals"].schema)
    with few_parts(t):
        S.resume(rows, inbox, None, checkpoint)
        t["arrivals"].repartition(2).write.mode("append").parquet(path)
        S.resume(rows, inbox, checkpoint, scratch(t.spark, "unused"))
    return S.read_inbox_table(t.spark, inbox).select("source", "event_id")


def json_pages(t):
    """Pages of items as a system's export leaves them: JSON files in a folder."""
    path = scratch(t.spark, "pages")
    items = t["polled"].select(F.col("id").cast("string").alias("id"), "position", "status")
    items.repartition(4).write.mode("append").json(path)
    return path, items.schema


@query("x03_connector_pages", "SELECT cast(id as varchar) AS id, position, status FROM {polled} WHERE position > 1704931200000")
def _(t):
    path, schema = json_pages(t)
    return P.poll(t.spark.read.schema(schema).json(path), 1704931200000).select("id", "position", "status")


@query("x03_connector_stream", "SELECT cast(id as varchar) AS id, position FROM {polled}")
def _(t):
    path, schema = json_pages(t)
    pages = P.poll(t.spark.readStream.schema(schema).json(path), 0, versioned=True).withColumn("source", F.lit("pages"))
    inbox = scratch(t.spark, "inbox")
    with few_parts(t):
        S.run_to_inbox(pages, inbox, scratch(t.spark, "checkpoint"), order="position")
    return S.read_inbox_table(t.spark, inbox).select("id", "position")
