"""Change feed and change topic queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.operators import inbox as I
from flowlink.plans.registry import query
from flowlink.sources import change_topic as C
from flowlink.sources import outbox as O

POSITION = "commit_lsn * 32768 + (row_number() OVER (PARTITION BY commit_lsn ORDER BY seq))"
EVENT_ID = "printf('%016X.%d', commit_lsn, tx_index)"
INDEXED = f"(SELECT *, row_number() OVER (PARTITION BY commit_lsn ORDER BY seq) AS tx_index, {POSITION} AS position FROM {{feed}})"
RESUME = 1000 * 32768 + 2  # inside the transaction committed at 1000


@query(
    "s02_change_feed",
    f"SELECT position, {EVENT_ID} AS event_id, op, id FROM {INDEXED} WHERE position > {RESUME} AND op IN ('insert', 'delete')",
)
def _(t):
    return O.read_changes(t["feed"], ("insert", "delete"), RESUME).select("position", "event_id", "op", "id")


@query(
    "s02_oversized_transactions",
    """
    SELECT commit_lsn, count(*) AS changes FROM (SELECT CASE WHEN id % 100 = 0 THEN 281474976710656 + customer ELSE commit_lsn END AS commit_lsn FROM {feed})
    WHERE commit_lsn > 281474976710655 GROUP BY commit_lsn
    """,
)
def _(t):
    lsn = F.when(F.col("id") % 100 == 0, F.lit(1 << 48) + F.col("customer")).otherwise(F.col("commit_lsn"))
    big = t["feed"].withColumn("commit_lsn", lsn)
    return O.oversized_transactions(big)


@query(
    "s03_resume_in_transaction",
    f"""
    SELECT {EVENT_ID} AS event_id, position FROM {INDEXED}
    WHERE position IN (SELECT position FROM {INDEXED} WHERE position > 32768 * 500 ORDER BY position LIMIT 303)
       OR position IN (SELECT position FROM {INDEXED} WHERE position > 32768 * 550 ORDER BY position LIMIT 100)
    """,
)
def _(t):
    # The second read starts again before the first one ended: the inbox drops the repeats.
    first = O.read_changes(t["feed"], after=32768 * 500, limit=303)
    second = O.read_changes(t["feed"], after=32768 * 550, limit=100)
    both = I.union_arrivals(first, second).select(F.lit("orders").alias("source"), "event_id", "position")
    return I.keep_first(both, order="position").select("event_id", "position")


@query(
    "s04_change_payload",
    """
    SELECT id, status AS status, CASE WHEN op = 'delete' THEN cast(cents - 1 as varchar) ELSE cast(cents as varchar) END AS cents,
           op = 'delete' OR id % 3 <> 0 AS has_note, cast(NULL as varchar) AS note
    FROM {feed}
    """,
)
def _(t):
    def row(cents):
        return F.create_map(
            F.lit("status"), F.col("status"), F.lit("cents"), cents.cast("string"), F.lit("note"), F.lit(None).cast("string")
        )

    feed = t["feed"].withColumns(
        {
            "new": row(F.col("cents")),
            "old": row(F.col("cents") - 1),
            "unchanged": F.when((F.col("id") % 3 == 0) & (F.col("op") != "delete"), F.array(F.lit("note"))),
        }
    )
    payload = feed.withColumn("payload", O.change_payload(unchanged="unchanged"))
    p = F.col("payload")
    return payload.select(
        "id", p["status"].alias("status"), p["cents"].alias("cents"), F.map_contains_key(p, "note").alias("has_note"),
        p["note"].alias("note"),
    )


def topic(t):
    return t["change_topic"].withColumnsRenamed({"topic_partition": "partition", "topic_offset": "offset"})


def offsets(t):
    """Stored offsets: partition 3 was never read."""
    return topic(t).filter("partition < 3").groupBy("partition").agg((F.floor(F.max("offset") / 4)).cast("bigint").alias("next_offset"))


_OFFSETS = "(SELECT topic_partition, cast(floor(max(topic_offset) / 4) as bigint) AS next_offset FROM {topic_truth} WHERE topic_partition < 3 GROUP BY topic_partition)"


@query(
    "s05_topic_read",
    f"""
    SELECT r.topic_partition AS "partition", topic_offset AS "offset", id FROM {{topic_truth}} r LEFT JOIN {_OFFSETS} o ON o.topic_partition = r.topic_partition
    WHERE topic_offset >= coalesce(next_offset, 0)
    """,
)
def _(t):
    return C.read_topic(topic(t), offsets(t)).select("partition", "offset", "id")


@query(
    "s05_latest_start",
    """
    WITH s AS (SELECT topic_partition, max(topic_offset) // 2 AS start FROM {topic_truth} GROUP BY topic_partition)
    SELECT r.topic_partition AS "partition", topic_offset AS "offset", id FROM {topic_truth} r JOIN s ON s.topic_partition = r.topic_partition WHERE topic_offset >= start
    """,
)
def _(t):
    # The topic as it is when the starts are stored is its first half; what comes later is read.
    half = topic(t).groupBy("partition").agg((F.floor(F.max("offset") / 2)).cast("bigint").alias("end_offset"))
    stored = C.resolve_starts(half, offsets(t).limit(0), "latest")
    return C.read_topic(topic(t), stored).select("partition", "offset", "id")


@query(
    "s05_next_offsets",
    """SELECT topic_partition AS "partition", max(topic_offset) + 1 AS next_offset FROM {topic_truth} GROUP BY topic_partition""",
)
def _(t):
    return C.next_offsets(C.read_topic(topic(t), offsets(t)), offsets(t))


@query(
    "s06_retention_gaps",
    f"""
    SELECT o.topic_partition AS "partition", next_offset, s.start_offset FROM {_OFFSETS} o
    JOIN (SELECT topic_partition, cast(floor(max(topic_offset) / 4) as bigint) + topic_partition - 1 AS start_offset FROM {{topic_truth}} GROUP BY topic_partition) s
      ON s.topic_partition = o.topic_partition
    WHERE next_offset < s.start_offset
    """,
)
def _(t):
    # Partition 2 lost a record, the others none.
    starts = topic(t).groupBy("partition").agg(F.floor(F.max("offset") / 4).cast("bigint").alias("s")).select(
        "partition", (F.col("s") + F.col("partition") - 1).alias("start_offset")
    )
    return C.retention_gaps(offsets(t), starts)


ROW = T.StructType().add("id", "long").add("customer", "long").add("status", "string").add("cents", "long")


def decoded(t):
    return C.decode(topic(t), ROW)


@query(
    "s07_envelope_decode",
    """
    SELECT id, topic_offset AS "offset", state, CASE WHEN state = 'ok' THEN code END AS op, CASE WHEN state = 'ok' THEN 1700000000000 + id END AS ts_ms,
           CASE WHEN state = 'ok' AND code <> 'd' THEN cents END AS after_cents, CASE WHEN state = 'ok' AND code IN ('u', 'd') THEN cents - 1 END AS before_cents
    FROM {topic_truth}
    """,
)
def _(t):
    return decoded(t).select(
        "id", "offset", "state", "op", "ts_ms", F.col("after.cents").alias("after_cents"), F.col("before.cents").alias("before_cents")
    )


@query("s07_rejects", """SELECT id, topic_offset AS "offset" FROM {topic_truth} WHERE state = 'invalid'""")
def _(t):
    return C.rejects(decoded(t)).select("id", "offset")


@query(
    "s08_change_events",
    """
    SELECT id, topic_offset AS "offset", customer, CASE WHEN code = 'd' THEN cents - 1 ELSE cents END AS cents,
           CASE code WHEN 'c' THEN 'create' WHEN 'u' THEN 'update' ELSE 'delete' END AS op, CASE WHEN code = 'u' THEN cents - 1 END AS before_cents,
           'shop' AS db, 6 AS source_fields, 1700000000000 + id AS ts_ms
    FROM {topic_truth} WHERE state = 'ok' AND code <> 'r' AND status = 'F'
    """,
)
def _(t):
    events = C.build_events(decoded(t), match={"status": "F"})
    p = "payload.debezium"
    return events.select(
        "id", "offset", "payload.customer", "payload.cents", f"{p}.op", F.col(f"{p}.before.cents").alias("before_cents"),
        F.col(f"{p}.source")["db"].alias("db"), F.size(f"{p}.source").alias("source_fields"),
        F.unix_millis(f"{p}.ts").alias("ts_ms"),
    )


_SEP = "chr(31)"


@query(
    "s09_change_identity",
    f"""
    SELECT id, topic_offset AS "offset", substr(sha256(concat(
             CASE WHEN id % 23 = 0 THEN 'other' ELSE 'postgresql' END, {_SEP}, code, {_SEP},
             CASE WHEN id % 23 = 0 THEN concat_ws({_SEP}, 'connector=other', 'db=shop', concat('lsn=', cast(commit_lsn as varchar)), 'name=shop', 'schema=public', 'table=orders', concat('txId=', cast(id as varchar)))
                  ELSE concat_ws({_SEP}, cast(commit_lsn as varchar), cast(id as varchar), '') END,
             {_SEP}, 'shop', {_SEP}, 'public', {_SEP}, 'orders', {_SEP}, '', {_SEP}, 'id=', cast(id as varchar))), 1, 32) AS event_id
    FROM {{topic_truth}} WHERE state = 'ok'
    """,
)
def _(t):
    return decoded(t).filter("state = 'ok'").select("id", "offset", C.change_id().alias("event_id"))


@query(
    "s10_logical_types",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, (epoch_us(o_orderdate) // 1000) + o_orderkey AS ms, (epoch_us(o_orderdate) // 1000) * 1000 + o_orderkey AS us,
           concat('00:', lpad(cast((o_orderkey // 60) % 60 as varchar), 2, '0'), ':', lpad(cast(o_orderkey % 60 as varchar), 2, '0'), '.5') AS clock,
           cast(o_custkey as varchar) AS doc,
           cast(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -o_orderkey END as decimal(18,2)) / 100 AS amount
    FROM {orders}
    """,
)
def _(t):
    key = F.col("o_orderkey")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    signed = F.when(key % 2 == 0, key).otherwise(-key)
    # Big-endian two's-complement bytes of a long are its 16 hex digits.
    wire = t["orders"].select(
        "o_orderkey", "o_custkey", F.unix_date(F.col("o_orderdate").cast("date")).alias("day"), (ms + key).alias("ms"),
        (ms * 1000 + key).alias("us"), ((key % 3600) * 1_000_000 + 500_000).alias("clock"),
        F.format_string('{"c":%d}', "o_custkey").alias("doc"), F.base64(F.unhex(F.lpad(F.hex(signed), 16, "0"))).alias("amount"),
    )
    c = F.col
    doc = C.logical_value(c("doc"), "io.debezium.data.Json")
    return wire.select(
        "o_orderkey",
        C.logical_value(c("day"), "io.debezium.time.Date").cast("string").alias("day"),
        F.unix_millis(C.logical_value(c("ms"), "io.debezium.time.Timestamp")).alias("ms"),
        F.unix_micros(C.logical_value(c("us"), "io.debezium.time.MicroTimestamp")).alias("us"),
        C.logical_value(c("clock"), "io.debezium.time.MicroTime").alias("clock"),
        F.variant_get(doc, "$.c", "string").alias("doc"),
        C.logical_value(c("amount"), "org.apache.kafka.connect.data.Decimal", 18, 2).cast("double").alias("amount"),
    )


@query(
    "change_topic_to_inbox",
    """
    SELECT count(*) AS events, count(DISTINCT id) AS ids, cast(sum(CASE WHEN code = 'd' THEN cents - 1 ELSE cents END) as bigint) AS cents
    FROM (SELECT DISTINCT id, code, cents, commit_lsn FROM {topic_truth} WHERE state = 'ok' AND code <> 'r')
    """,
)
def _(t):
    events = C.build_events(decoded(t)).select(
        F.lit("orders").alias("source"), C.change_id().alias("event_id"), "payload", F.col("offset").alias("arrived")
    )
    inbox = I.keep_first(events)
    return inbox.agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("payload.id").alias("ids"), F.sum("payload.cents").alias("cents")
    )
