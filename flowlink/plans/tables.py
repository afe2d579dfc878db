"""Tables derived from the driver tables (one SELECT each, the same for Spark and DuckDB)."""

from __future__ import annotations

from flowlink.plans.registry import derive

derive(
    "outbox",
    "SELECT event_id AS id, event_type AS event, user_id, value, props, ts FROM {events}",
)

# Every event as first read; each seventh is delivered again by a webhook later on.
derive(
    "arrivals",
    """
    SELECT concat('shop/', event_type) AS source, cast(event_id as string) AS event_id, user_id,
           event_id AS arrived, 'poll' AS via
    FROM {events}
    UNION ALL
    SELECT concat('shop/', event_type), cast(event_id as string), user_id + 1000,
           event_id + 100000000000, 'webhook'
    FROM {events} WHERE event_id % 7 = 0
    """,
)

derive(
    "stored_inbox",
    """
    SELECT concat('shop/', event_type) AS source, cast(event_id as string) AS event_id,
           event_id AS seq, ts AS received_at
    FROM {events} WHERE event_id % 10 = 3
    """,
)

# Changes of one table: five to a transaction.
derive(
    "feed",
    """
    SELECT cast(floor(o_orderkey / 5) as bigint) AS commit_lsn, o_orderkey AS seq, 'orders' AS relation,
           CASE o_orderkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'update' ELSE 'insert' END AS op,
           o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status,
           cast(round(o_totalprice * 100) as bigint) AS cents
    FROM {orders}
    """,
)

_ROW = """concat('{"id":', cast(id as string), ',"customer":', cast(customer as string), ',"status":"', status, '","cents":', cast(cents as string), '}')"""
_OLD = _ROW.replace("cast(cents as string)", "cast(cents - 1 as string)")

# The same changes as topic records: tombstones, envelopes with and without their schema,
# flattened records and broken text.
derive(
    "envelope_rows",
    f"""
    SELECT id, id % 4 AS topic_partition, cast(floor(id / 4) as bigint) AS topic_offset, customer, status, cents,
           CASE WHEN id % 19 = 0 THEN 'r' WHEN op = 'delete' THEN 'd' WHEN op = 'update' THEN 'u' ELSE 'c' END AS code,
           commit_lsn, {_ROW} AS new_row, {_OLD} AS old_row
    FROM {{feed}}
    """,
)
derive(
    "envelope_texts",
    """
    SELECT id, topic_partition, topic_offset, customer, status, cents, code, commit_lsn,
           concat('{"op":"', code, '","ts_ms":', cast(1700000000000 + id as string),
                  ',"source":{"version":"3.0","connector":"', CASE WHEN id % 23 = 0 THEN 'other' ELSE 'postgresql' END,
                  '","name":"shop","db":"shop","schema":"public","table":"orders","snapshot":"false","ts_ms":',
                  cast(1700000000000 + id as string), ',"lsn":', cast(commit_lsn as string), ',"txId":',
                  cast(id as string), '},"before":',
                  CASE WHEN code IN ('c', 'r') THEN 'null' ELSE old_row END, ',"after":',
                  CASE WHEN code = 'd' THEN 'null' ELSE new_row END, '}') AS envelope, new_row
    FROM {envelope_rows}
    """,
)
derive(
    "change_topic",
    """
    SELECT id, topic_partition, topic_offset, concat('{"id":', cast(id as string), '}') AS key,
           CASE WHEN id % 11 = 0 THEN ''
                WHEN id % 97 = 0 THEN new_row
                WHEN id % 101 = 0 THEN '{oops'
                WHEN id % 3 = 0 THEN concat('{"schema":{"type":"struct"},"payload":', envelope, '}')
                ELSE envelope END AS value
    FROM {envelope_texts}
    UNION ALL
    SELECT id, topic_partition, topic_offset + 100000000, concat('{"schema":{"type":"struct"},"payload":{"id":', cast(id as string), '}}'),
           envelope
    FROM {envelope_texts} WHERE id % 13 = 0
    """,
)
# What a reader of change_topic must make of it, kept apart from its text.
derive(
    "topic_truth",
    """
    SELECT id, topic_partition, topic_offset, code, customer, status, cents, commit_lsn,
           CASE WHEN id % 11 = 0 THEN 'tombstone'
                WHEN id % 97 = 0 OR id % 101 = 0 THEN 'invalid' ELSE 'ok' END AS state
    FROM {envelope_rows}
    UNION ALL
    SELECT id, topic_partition, topic_offset + 100000000, code, customer, status, cents, commit_lsn, 'ok'
    FROM {envelope_rows} WHERE id % 13 = 0
    """,
)

# A polled list: positions are hours, so many items share one.
derive(
    "polled",
    """
    SELECT event_id AS id, epoch_ms(ts) AS changed_ms,
           epoch_ms(ts) - epoch_ms(ts) % 3600000 AS position, event_type AS status, user_id, value
    FROM {events}
    """,
)

derive(
    "pointers",
    """
    SELECT event_id AS number, 'DEBMAS' AS object_class, cast(user_id % 3 as string) AS object_id,
           cast(cast(floor(event_id / 6) as bigint) as string) AS change_number, event_type AS field,
           user_id AS changed_by, epoch_ms(ts) AS created_ms
    FROM {events}
    """,
)

derive(
    "xref",
    """
    SELECT 'Customer' AS entity, 'shop' AS system, cast(c_custkey as string) AS source_id,
           concat('C-', cast(cast(floor(c_custkey / 3) as bigint) as string)) AS master_id
    FROM {customer} WHERE c_custkey % 10 <> 9 AND c_custkey % 10 <> 8
    UNION ALL
    SELECT 'Customer', 'legacy', cast(c_custkey as string),
           concat('C-', cast(cast(floor(c_custkey / 3) as bigint) as string))
    FROM {customer} WHERE c_custkey % 10 = 8 OR c_custkey % 10 = 7
    """,
)

# Order references to customers, as documents carry them.
derive(
    "order_refs",
    """
    SELECT o_orderkey AS id, cast(o_custkey as string) AS customer_ref, o_totalprice AS amount,
           o_orderpriority AS priority, o_orderstatus AS status
    FROM {orders}
    """,
)

# People to match: names are equal or unrelated, so that no comparison hangs on a close name.
derive(
    "people",
    """
    SELECT c_custkey AS id, cast(c_custkey as string) AS source_id,
           concat('C-', cast(cast(floor(c_custkey / 3) as bigint) as string)) AS master_id,
           CASE WHEN c_custkey % 5 = 0 THEN concat('U', cast(cast(floor(c_custkey / 2) as bigint) as string), '@gmail.com')
                WHEN c_custkey % 29 = 0 THEN '@nobody'
                ELSE concat('  u', cast(cast(floor(c_custkey / 2) as bigint) as string), '@', c_mktsegment,
                            cast(c_nationkey as string), '.Example ') END AS email,
           CASE WHEN c_custkey % 17 = 0 THEN NULL
                ELSE concat(' ', substr(md5(cast(cast(floor(c_custkey / 4) as bigint) as string)), 1, 12), ',, ') END AS name,
           CASE WHEN c_custkey % 3 = 1 THEN concat('at u ', cast(cast(floor(c_custkey / 6) as bigint) as string)) END AS vat
    FROM {customer}
    """,
)

derive(
    "vendors",
    """
    SELECT s_suppkey AS id, cast(s_suppkey as string) AS source_id,
           concat('S-', cast(cast(floor(s_suppkey / 3) as bigint) as string)) AS master_id,
           concat('v', cast(cast(floor(s_suppkey / 2) as bigint) as string), '@n', cast(s_nationkey as string), '.example') AS email,
           CASE WHEN s_suppkey % 7 <> 0 THEN substr(md5(cast(cast(floor(s_suppkey / 6) as bigint) as string)), 1, 12) END AS name,
           CASE WHEN s_suppkey % 3 <> 1 THEN concat('vat', cast(cast(floor(s_suppkey / 3) as bigint) as string)) END AS vat
    FROM {supplier}
    """,
)

# Links an export proposes: some to another master, some given twice, some incomplete.
derive(
    "proposed",
    """
    SELECT CASE WHEN c_custkey % 31 = 0 THEN '' ELSE cast(c_custkey as string) END AS source_id,
           CASE WHEN c_custkey % 37 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN 'C-other'
                ELSE concat(' C-', cast(cast(floor(c_custkey / 3) as bigint) as string)) END AS master_id,
           c_custkey AS seq, lower(c_mktsegment) AS email
    FROM {customer}
    UNION ALL
    SELECT cast(c_custkey as string), 'C-last', c_custkey + 100000000000, concat('m', cast(c_custkey as string), '@x.example')
    FROM {customer} WHERE c_custkey % 11 = 0
    """,
)

# Governed write requests, one per order.
derive(
    "requests",
    """
    SELECT o_orderkey AS run_id, 1 AS step, 'erp' AS target, 'create-order' AS operation, 'delete-order' AS compensation,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority = '2-HIGH' THEN 'read'
                WHEN o_orderkey % 50 = 0 THEN 'odd' ELSE 'low' END AS risk,
           o_orderkey % 3 <> 0 AS is_operator, o_orderkey % 6 = 0 AS is_reader, o_orderkey % 4 = 0 AS agent,
           CASE WHEN o_orderkey % 9 = 0 THEN 'approved' WHEN o_orderkey % 9 = 1 THEN 'rejected' END AS approval,
           o_orderkey % 25 = 0 AS require_approval, o_totalprice AS amount,
           concat('ORD-', cast(o_orderkey as string)) AS idempotency_key
    FROM {orders}
    """,
)

# What the ledger holds already; claimed minutes are counted back from "now" = 1000.
derive(
    "ledger",
    """
    SELECT concat('erp/create-order/ORD-', cast(o_orderkey as string)) AS key,
           CASE WHEN o_orderkey % 12 = 0 THEN 'inflight' ELSE 'done' END AS status,
           CASE WHEN o_orderkey % 24 = 0 THEN 999 ELSE 900 END AS claimed_minute
    FROM {orders} WHERE o_orderkey % 6 = 0
    """,
)

derive(
    "runs",
    """
    SELECT event_id AS run_id, event_type AS workflow,
           CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN 'failed' WHEN event_id % 10 = 0 THEN 'running' ELSE 'completed' END AS status,
           CASE WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'Unresolved' END AS failure_type,
           epoch_ms(ts) AS started_ms, epoch_ms(ts) + cast(round(value * 1000) as bigint) AS closed_ms,
           (event_id % 5) * 100 AS waited_ms, user_id, event_id % 4 = 1 AS skipped
    FROM {events}
    """,
)

derive(
    "writes_log",
    """
    SELECT event_id AS seq, concat('t', cast(user_id % 7 as string)) AS target, event_type AS operation,
           CASE WHEN event_id % 23 < 9 THEN 'failed' WHEN event_id % 11 = 0 THEN 'duplicate' ELSE 'committed' END AS status,
           epoch_ms(ts) AS at_ms, value AS duration, user_id % 7 < 3 AS metered
    FROM {events}
    """,
)
