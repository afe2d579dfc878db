"""Outbox, polling, inbox, webhook and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.functions.documents import variant_at
from flowlink.operators import inbox as I
from flowlink.plans.registry import derive, query
from flowlink.sources import messages as X
from flowlink.sources import outbox as O
from flowlink.sources import polling as P
from flowlink.sources import records as R
from flowlink.sources import webhooks as H

NOW = 1706745600000  # 2024-02-01T00:00:00Z, just past the last event
HOUR = 3_600_000
AFTER = 1704931200000  # 2024-01-11T00:00:00Z


@query(
    "s01_outbox_read",
    "SELECT id, cast(id as varchar) AS event_id, id AS position, value FROM {outbox} WHERE event = 'purchase' AND id > 1000 ORDER BY id LIMIT 500",
)
def _(t):
    return O.read_outbox(t["outbox"], "purchase", 1000, 500).select("id", "event_id", "position", "value")


@query(
    "s11_poll_changes",
    """
    SELECT id, position, concat(cast(id as varchar), '@', cast(position as varchar)) AS event_id
    FROM {polled} WHERE position > 1704931200000 ORDER BY position, id LIMIT 1000
    """,
)
def _(t):
    return P.poll(t["polled"], AFTER, 1000, versioned=True).select("id", "position", "event_id")


@query(
    "s12_boundary_trim",
    """
    WITH page AS (SELECT position FROM {polled} WHERE position > 1704931200000 ORDER BY position LIMIT 1000),
         last AS (SELECT max(position) AS p FROM page),
         upper AS (SELECT coalesce((SELECT max(position) FROM page WHERE position < (SELECT p FROM last)), (SELECT p FROM last)) AS u),
         cut AS (SELECT count(*) > 1000 AS c FROM {polled} WHERE position > 1704931200000)
    SELECT id, position FROM {polled} WHERE position > 1704931200000 AND (position <= (SELECT u FROM upper) OR NOT (SELECT c FROM cut))
    """,
)
def _(t):
    return P.poll_whole_positions(t["polled"], AFTER, 1000).select("id", "position")


@query(
    "s12_boundary_one_position",
    """
    WITH page AS (SELECT position FROM {polled} WHERE position > 1704931200000 ORDER BY position LIMIT 3),
         last AS (SELECT max(position) AS p, min(position) = max(position) AS same FROM page),
         upper AS (SELECT CASE WHEN same THEN p ELSE (SELECT max(position) FROM page WHERE position < p) END AS u, same FROM last)
    SELECT id, position, (SELECT same FROM upper) AS one_position FROM {polled}
    WHERE position > 1704931200000 AND position <= (SELECT u FROM upper)
    """,
)
def _(t):
    batch = P.poll_whole_positions(t["polled"], AFTER, 3).select("id", "position")
    found = P.boundary(P.newer(t["polled"], AFTER), 3)
    return batch.withColumn("one_position", found.select("one_position").scalar())


@query(
    "s13_settle_delay",
    "SELECT id, position FROM {polled} WHERE position > 1704931200000 AND position <= 1706745600000 - 864000000",
)
def _(t):
    return P.newer(t["polled"], AFTER, settle_ms=240 * HOUR, now_ms=NOW).select("id", "position")


@query(
    "s14_lookback_floor",
    """
    WITH c AS (SELECT event_type AS name, CASE WHEN event_type = 'view' THEN 0 ELSE min(epoch_ms(ts)) + min(user_id) * 86400000 END AS position FROM {events} GROUP BY event_type)
    SELECT name, greatest(position, 1705536060000) AS position,
           CASE WHEN position > 0 AND position < 1705536060000 THEN position END AS gap_from,
           CASE WHEN position > 0 AND position < 1705536060000 THEN 1705536060000 END AS gap_to
    FROM c
    """,
)
def _(t):
    e = t["events"].groupBy(F.col("event_type").alias("name")).agg(
        (F.min(F.unix_millis(F.col("ts").cast("timestamp"))) + F.min("user_id") * 86400000).alias("first")
    )
    cursors = e.select("name", F.when(F.col("name") == "view", F.lit(0)).otherwise(F.col("first")).alias("position"))
    return P.raise_to_lookback(cursors, NOW, 336 * HOUR)


@query(
    "s15_filter_with_cursor",
    """
    SELECT 'event' AS kind, id, position FROM {polled} WHERE position > 1704931200000 AND status = 'error'
    UNION ALL SELECT 'cursor', NULL, max(position) FROM {polled} WHERE position > 1704931200000
    """,
)
def _(t):
    kept, cursor = P.split_filtered(P.newer(t["polled"], AFTER), F.col("status") == "error")
    marks = cursor.select(F.lit("cursor").alias("kind"), F.lit(None).cast("bigint").alias("id"), F.col("cursor").alias("position"))
    return kept.select(F.lit("event").alias("kind"), "id", "position").unionByName(marks)


@query(
    "s16_composite_cursor",
    """
    SELECT event_id, cast(floor(epoch_ms(ts) / 1000) as bigint) * 2147483648 + event_id AS position,
           cast(floor(epoch_ms(ts) / 1000) as bigint) AS seconds, event_id AS id,
           cast(floor(epoch_ms(ts) / 1000) as bigint) AS old_seconds, cast(2147483647 as bigint) AS old_id
    FROM {events}
    """,
)
def _(t):
    ts = F.col("ts").cast("timestamp")
    e = t["events"].select("event_id", P.composite_position(ts, F.col("event_id")).alias("position"), F.unix_millis(ts).alias("ms"))
    new, old = P.decode_composite(F.col("position")), P.decode_composite(F.col("ms"))
    return e.select(
        "event_id", "position", new["seconds"].alias("seconds"), new["id"].alias("id"),
        old["seconds"].alias("old_seconds"), old["id"].cast("bigint").alias("old_id"),
    )


@query(
    "s17_position_formats",
    """
    SELECT id, concat('/Date(', cast(changed_ms as varchar), '+0000)/') AS msjson,
           strftime(make_timestamp(changed_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS rfc3339,
           cast(cast(floor(changed_ms / 1000) as bigint) as varchar) AS unix,
           changed_ms AS from_msjson, changed_ms - 7200000 AS from_rfc3339, cast(floor(changed_ms / 1000) as bigint) * 1000 AS from_unix,
           cast(NULL as bigint) AS from_bad
    FROM {polled}
    """,
)
def _(t):
    ms = F.col("changed_ms")
    texts = t["polled"].select(
        "id", P.format_position(ms, "msjson").alias("msjson"), P.format_position(ms, "rfc3339").alias("rfc3339"),
        P.format_position(ms, "unix").alias("unix"), "status",
    )
    shifted = F.regexp_replace("rfc3339", "Z$", "+02:00")
    return texts.select(
        "id", "msjson", "rfc3339", "unix",
        P.parse_position(F.col("msjson"), "msjson").alias("from_msjson"),
        P.parse_position(shifted, "rfc3339").alias("from_rfc3339"),
        P.parse_position(F.col("unix"), "unix").alias("from_unix"),
        P.parse_position(F.col("status")).alias("from_bad"),
    )


@query(
    "s18_newest_first_guard",
    """
    SELECT 'narrow' AS reading, count(*) AS new_items, count(*) <= 100 AS readable FROM {polled} WHERE position > 1704931200000
    UNION ALL SELECT 'wide', count(*), count(*) <= 1000000000 FROM {polled} WHERE position > 1704931200000
    """,
)
def _(t):
    a = P.guard_new(t["polled"], AFTER, 100).withColumn("reading", F.lit("narrow"))
    return a.unionByName(P.guard_new(t["polled"], AFTER, 10**9).withColumn("reading", F.lit("wide")))


@query(
    "s19_capped_window",
    """
    WITH settled AS (SELECT id, position FROM {polled} WHERE position > 1704931200000 AND position <= 1706745600000 - 259200000),
         start AS (SELECT min(position) AS p FROM (SELECT position FROM settled ORDER BY position DESC LIMIT 500))
    SELECT 'event' AS kind, id, position, cast(NULL as bigint) AS gap_from FROM settled WHERE position > (SELECT p FROM start)
    UNION ALL SELECT 'gap', NULL, p, 1704931200000 FROM start
    """,
)
def _(t):
    items, gap = P.narrow_window(t["polled"], AFTER, 500, settle_ms=72 * HOUR, now_ms=NOW)
    none = F.lit(None).cast("bigint")
    return items.select(F.lit("event").alias("kind"), "id", "position", none.alias("gap_from")).unionByName(
        gap.select(F.lit("gap").alias("kind"), none.alias("id"), F.col("gap_to").alias("position"), "gap_from")
    )


# --- Inbox ------------------------------------------------------------------------------


@query(
    "k01_keep_first",
    """
    SELECT a.source, a.event_id, a.user_id, a.via, a.arrived FROM {arrivals} a
    WHERE a.arrived < 100000000000 AND NOT EXISTS (SELECT 1 FROM {stored_inbox} s WHERE s.source = a.source AND s.event_id = a.event_id)
    """,
)
def _(t):
    return I.keep_first(t["arrivals"], t["stored_inbox"])


@query(
    "k01_new_per_source",
    """
    SELECT a.source, count(*) AS added FROM {arrivals} a
    WHERE a.arrived < 100000000000 AND NOT EXISTS (SELECT 1 FROM {stored_inbox} s WHERE s.source = a.source AND s.event_id = a.event_id)
    GROUP BY a.source
    """,
)
def _(t):
    return I.new_per_source(I.keep_first(t["arrivals"], t["stored_inbox"]))


@query(
    "u01_union_of_arrivals",
    """
    SELECT source, event_id, min(arrived) AS arrived, count(*) AS deliveries FROM (
      SELECT source, event_id, arrived FROM {arrivals}
      UNION ALL SELECT concat('shop/', event_type), cast(event_id as varchar), event_id + 500 FROM {events} WHERE event_id % 5 = 0)
    GROUP BY source, event_id
    """,
)
def _(t):
    columns = ["source", "event_id", "user_id", "arrived", "via"]
    arrivals = t["arrivals"].select(*columns)
    subscription = t["events"].filter(F.col("event_id") % 5 == 0).select(
        F.concat(F.lit("shop/"), "event_type").alias("source"), F.col("event_id").cast("string").alias("event_id"), "user_id",
        (F.col("event_id") + 500).alias("arrived"), F.lit("subscription").alias("via"),
    )
    union = I.union_arrivals(arrivals.filter("via = 'poll'"), arrivals.filter("via = 'webhook'"), subscription)
    counted = union.groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return I.keep_first(union).select("source", "event_id", "arrived").join(counted, ["source", "event_id"])


@query(
    "l04_inbox_batch",
    "SELECT event_id, seq FROM {stored_inbox} WHERE source = 'shop/error' AND seq > 500 ORDER BY seq LIMIT 100",
)
def _(t):
    return O.read_inbox(t["stored_inbox"], "shop/error", 500, 100).select("event_id", "seq")


@query("k13_prune_inbox", "SELECT source, event_id, seq FROM {stored_inbox} WHERE received_at >= TIMESTAMP '2024-01-20 00:00:00'")
def _(t):
    return I.prune(t["stored_inbox"], F.lit("2024-01-20").cast("timestamp_ntz")).select("source", "event_id", "seq")


@query(
    "cursors_only_move_forward",
    """
    SELECT source AS name, max(seq) AS position FROM (
      SELECT source, seq FROM {stored_inbox} UNION ALL SELECT concat('shop/', event_type), max(event_id) - 5000 FROM {events} GROUP BY event_type)
    GROUP BY source
    """,
)
def _(t):
    stored = t["events"].groupBy(F.concat(F.lit("shop/"), "event_type").alias("name")).agg((F.max("event_id") - 5000).alias("position"))
    return I.advance_cursors(stored, t["stored_inbox"].select(F.col("source").alias("name"), F.col("seq").alias("position")))


# --- Webhooks ---------------------------------------------------------------------------

SECRETS = [
    H.Secret("pay", b"pay-secret", "stripe"),
    H.Secret("shop", b"a-shop-secret-longer-than-one-block-of-the-hash-function-0123456789-0123456789", "shopify"),
    H.Secret("crm", b"crm-secret", "hmac-sha256", "X-Signature", "sha256=", "hex"),
    H.Secret("erp", b"erp-secret", "hmac-sha256", "X-Sig64", "", "base64"),
]


def deliveries(t):
    """Signed webhook deliveries, one per event; some forged, stale, broken or filtered."""
    key = F.col("event_id")
    endpoint = F.element_at(F.array(*[F.lit(s.endpoint) for s in SECRETS]), (key % 4 + 1).cast("int"))
    items = F.format_string(
        '{"data":[{"id":%d,"status":"%s","ts":%d},{"id":%d,"status":"%s","ts":%d}]}',
        key * 2, F.col("event_type"), key, key * 2 + 1, F.lit("view"), key,
    )
    body = F.when(key % 31 == 0, F.lit("{broken")).when(key % 37 == 0, F.lit('{"data":7}')).otherwise(items)
    raw = t["events"].select("event_id", endpoint.alias("endpoint"), body.alias("body"))
    signed = raw.join(H.secrets_table(t.spark, SECRETS), "endpoint")
    stamp = F.when(key % 13 == 0, F.lit(NOW // 1000 - 301)).otherwise(F.lit(NOW // 1000 - 299)).cast("string")
    message = F.when(F.col("signature") == "stripe", F.concat(stamp, F.lit("."), F.col("body"))).otherwise(F.col("body"))
    mac = H.hmac_sha256(F.col("inner"), F.col("outer"), message)
    sent = F.when(key % 5 == 0, F.reverse(mac)).otherwise(mac)
    in64 = F.base64(F.unhex(sent))
    headers = (
        F.when(F.col("signature") == "stripe", F.create_map(F.lit("Stripe-Signature"), F.concat(F.lit("t="), stamp, F.lit(",v1=00, v1="), sent)))
        .when(F.col("signature") == "shopify", F.create_map(F.lit("X-Shopify-Hmac-Sha256"), in64))
        .when(F.col("encoding") == "base64", F.create_map(F.lit("X-Sig64"), in64))
        .otherwise(F.create_map(F.lit("X-Signature"), F.concat(F.lit("sha256="), sent)))
    )
    return signed.select(key.alias("delivery"), "endpoint", "body", headers.alias("headers"))


@query(
    "s20_webhook_intake",
    """
    WITH d AS (SELECT event_id, event_type, event_id % 5 <> 0 AND NOT (event_id % 4 = 0 AND event_id % 13 = 0) AS good FROM {events}),
    i AS (SELECT event_id, event_type AS status, good, 0 AS n FROM d UNION ALL SELECT event_id, 'view', good, 1 FROM d)
    SELECT event_id AS delivery, result, name FROM (
      SELECT event_id, CASE WHEN NOT good THEN 'unauthenticated' WHEN event_id % 31 = 0 OR event_id % 37 = 0 THEN 'invalid'
                            WHEN status <> 'view' THEN 'ignored' ELSE 'accepted' END AS result,
             CASE WHEN good AND event_id % 31 <> 0 AND event_id % 37 <> 0 AND status = 'view'
                  THEN concat(cast(event_id * 2 + n as varchar), '@', cast(event_id as varchar)) END AS name, n,
             good AND event_id % 31 <> 0 AND event_id % 37 <> 0 AS unpacked
      FROM i) WHERE unpacked OR n = 0
    """,
)
def _(t):
    known = H.authenticate(deliveries(t), H.secrets_table(t.spark, SECRETS), NOW // 1000)
    out = H.receive(known, "data", "id", "ts", filters={"status": "view"})
    return out.select(F.col("event_id").alias("name"), "result", F.col("delivery"))


# --- Messages ---------------------------------------------------------------------------

derive(
    "record_changes",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
           event_type AS stage, CASE WHEN event_id % 3 = 0 THEN user_id END AS owner, event_id % 6 = 1 AS owner_cleared
    FROM {events}
    """,
)


@query(
    "s21_change_event_fan_out",
    """
    WITH r AS (SELECT *, range(event_id % 3 + 1) AS ids FROM {record_changes} WHERE change_type <> 'DELETE' AND stage = 'purchase')
    SELECT CASE WHEN event_id % 3 > 0 THEN concat('E', cast(event_id as varchar), '.', cast(i as varchar)) ELSE concat('E', cast(event_id as varchar)) END AS event_id,
           concat('R', cast(event_id * 10 + i as varchar)) AS record_id,
           concat_ws(',', CASE WHEN owner IS NOT NULL THEN concat('owner=', cast(owner as varchar)) WHEN owner_cleared THEN 'owner=NULL' END, 'stage=purchase') AS changed
    FROM (SELECT *, unnest(ids) AS i FROM r)
    """,
)
def _(t):
    ids = F.transform(F.sequence(F.lit(0), F.col("event_id") % 3), lambda i: F.concat(F.lit("R"), (F.col("event_id") * 10 + i).cast("string")))
    events = t["record_changes"].withColumn("record_ids", ids).select(
        F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("event_id"), "change_type", "record_ids",
        F.when(F.col("owner_cleared"), F.array(F.lit("owner.name"))).alias("nulled_fields"), "stage", "owner",
    )
    out = X.fan_out(events, ["stage", "owner"], ["create", "update"], {"stage": "purchase"})
    pairs = F.array_sort(F.map_entries("changed"))
    text = F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("NULL")))), ",")
    return out.select("event_id", "record_id", text.alias("changed"))


@query(
    "s22_field_bitmaps",
    """
    SELECT event_id, concat_ws(',', CASE WHEN event_id % 2 = 1 THEN 'f0' END, CASE WHEN floor(event_id / 2) % 2 = 1 THEN 'f1' END,
             CASE WHEN floor(event_id / 64) % 2 = 1 THEN 'f6' END, 'f70', 'f2.b') AS fields
    FROM {events}
    """,
)
def _(t):
    low = F.lpad(F.hex(F.col("event_id").bitwiseAND(F.lit(67))), 17, "0")
    bitmap = F.concat(F.lit("0x4"), low)
    fields = [f"f{i}" for i in range(72)]
    names = X.bitmap_fields(F.array(bitmap, F.lit("2-0x2"), F.lit("junk")), fields, {2: ["a", "b"]})
    return t["events"].select("event_id", F.array_join(names, ",").alias("fields"))


@query(
    "s23_change_pointers",
    """
    WITH cut AS (SELECT min(number) AS n FROM {pointers} WHERE number > 100 AND created_ms > 1706745600000 - 864000000),
    p AS (SELECT * FROM {pointers} WHERE number > 100 AND number < (SELECT coalesce(n, 9223372036854775807) FROM cut)),
    f AS (SELECT *, coalesce(object_id = lag(object_id) OVER w AND change_number = lag(change_number) OVER w, false) AS same FROM p WINDOW w AS (ORDER BY number)),
    g AS (SELECT *, max(CASE WHEN NOT same THEN number END) OVER (ORDER BY number) AS first_number FROM f)
    SELECT first_number, max(number) AS position, object_id, change_number, count(*) AS changes, min(created_ms) AS changed_ms,
           min(CASE WHEN number = first_number THEN changed_by END) AS changed_by
    FROM g GROUP BY first_number, object_id, change_number
    """,
)
def _(t):
    settled = X.settled_pointers(t["pointers"], 100, NOW - 240 * HOUR)
    return X.pointer_events(X.pointer_changes(settled)).drop("object_class")


def segments(t):
    """Two-level order messages: a head per order and its lines (fixed width)."""
    o = t["orders"].select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderkey") % 3).cast("int").alias("n"))
    head = o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("docnum"), F.lit("000001").alias("segnum"),
        F.lit("E1HEAD ").alias("segnam"), F.lit("000000").alias("psgnum"),
        F.concat(F.rpad(F.col("o_custkey").cast("string"), 10, " "), F.rpad("o_orderpriority", 15, " "), F.lit("   ")).alias("sdata"),
    )
    line = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).select(
        F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("docnum"),
        F.lpad((F.col("i") + 2).cast("string"), 6, "0").alias("segnum"), F.lit("E1LINE").alias("segnam"), F.lit("000001").alias("psgnum"),
        F.concat(F.rpad(F.concat(F.lit("M"), F.col("i").cast("string")), 8, " "), F.lpad((F.col("i") * 5).cast("string"), 4, "0")).alias("sdata"),
    )
    return head.unionByName(line)


DEFINITION = [
    ("E1HEAD", "CUSTOMER", 63, 10), ("E1HEAD", "PRIORITY", 73, 15), ("E1HEAD", "NOTE", 88, 20), ("E1HEAD", "LATE", 120, 5),
    ("E1LINE", "MATERIAL", 0, 8), ("E1LINE", "QUANTITY", 8, 4),
]


def definition(t):
    return t.spark.createDataFrame(DEFINITION, "segment string, field string, offset int, length int")


@query(
    "s24_segment_assembly",
    """
    SELECT concat('SHOP/', lpad(cast(o_orderkey as varchar), 16, '0')) AS event_id, cast(o_custkey as varchar) AS customer,
           o_orderpriority AS priority, 2 AS field_count, cast(o_orderkey % 3 + 1 as integer) AS children,
           'M0' AS first_material, lpad(cast((o_orderkey % 3) * 5 as varchar), 4, '0') AS last_quantity
    FROM {orders}
    """,
)
def _(t):
    tree = X.attach_children(X.parse_segments(segments(t), definition(t)))
    kids = F.col("children")
    return tree.select(
        X.document_event_id(F.lit("SHOP "), F.col("docnum")).alias("event_id"),
        F.col("fields")["CUSTOMER"].alias("customer"), F.col("fields")["PRIORITY"].alias("priority"),
        F.size("fields").alias("field_count"), F.size(kids).alias("children"),
        F.map_from_entries(kids[0]["fields"])["MATERIAL"].alias("first_material"),
        F.map_from_entries(F.element_at(kids, -1)["fields"])["QUANTITY"].alias("last_quantity"),
    )


@query(
    "s24_nested_segments",
    """
    SELECT docnum, segnum, 'S' || substr(segnum, 6, 1) AS segment, level, path FROM (
      SELECT lpad(cast(o_orderkey as varchar), 16, '0') AS docnum, s.segnum, s.level, s.path FROM {orders},
        (VALUES ('000001', 1, '/000001'), ('000002', 2, '/000001/000002'), ('000003', 3, '/000001/000002/000003'),
                ('000004', 4, '/000001/000002/000003/000004'), ('000005', 1, '/000005'), ('000006', 2, '/000005/000006'), ('000007', 1, '/000007')) s(segnum, level, path))
    """,
)
def _(t):
    # A chain of four, one whose parent is not there, its child, and one that names itself later.
    parents = {1: "000000", 2: "1", 3: "000002", 4: " 3 ", 5: "000099", 6: "5", 7: "8"}
    rows = [F.struct(F.lit(f"{n:06d}").alias("segnum"), F.lit(f"S{n}").alias("segnam"), F.lit(p).alias("psgnum")) for n, p in parents.items()]
    data = t["orders"].select(F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("docnum"), F.inline(F.array(*rows)))
    parsed = X.parse_segments(data.withColumn("sdata", F.lit("")), definition(t))
    return X.segment_tree(parsed).select("docnum", "segnum", "segment", "level", "path")


@query(
    "s24_control_record",
    """
    SELECT o_orderkey AS id, lpad(cast(o_orderkey as varchar), 16, '0') AS docnum, 'ORDERS05' AS idoctyp,
           CASE WHEN o_orderkey % 3 > 0 THEN 'SHOP' END AS sndprn, cast(CASE WHEN o_orderkey % 3 > 0 THEN 3 ELSE 2 END as integer) AS fields
    FROM {orders}
    """,
)
def _(t):
    control = F.create_map(
        F.lit("DOCNUM"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), F.lit("IDOCTYP"), F.lit("ORDERS05  "),
        F.lit("SNDPRN"), F.when(F.col("o_orderkey") % 3 > 0, "SHOP ").otherwise("  "), F.lit("STATUS"), F.lit("53"),
    )
    told = t["orders"].select(F.col("o_orderkey").alias("id"), X.control_block(control).alias("idoc"))
    kept = F.col("idoc")
    return told.select("id", kept["docnum"].alias("docnum"), kept["idoctyp"].alias("idoctyp"), kept["sndprn"].alias("sndprn"), F.size(kept).alias("fields"))


@query(
    "s25_message_routing",
    """
    SELECT 'buy' AS event, count(*) AS messages FROM {events} WHERE event_type = 'purchase'
    UNION ALL SELECT 'activity', count(*) FROM {events} WHERE event_type = 'purchase' OR event_type LIKE 'v%'
    UNION ALL SELECT 'ignored', count(*) FROM {events} WHERE event_type <> 'purchase' AND event_type NOT LIKE 'v%'
    """,
)
def _(t):
    routed = X.route(t["events"].select("event_id", "event_type"), "event_type", {"buy": ["purchase"], "activity": ["v*", "purchase"]})
    counts = routed.filter(F.col("event").isNotNull()).groupBy("event").agg(F.count(F.lit(1)).alias("messages"))
    return counts.unionByName(X.ignored(routed).select(F.lit("ignored").alias("event"), F.col("ignored").alias("messages")))


def cloud_messages(t):
    """Cloud events in structured, base64 and binary mode; some broken."""
    key = F.col("event_id")
    data = F.format_string('{"user":%d,"kind":"%s"}', F.col("user_id"), F.col("event_type"))
    kind = F.concat(F.lit("shop."), "event_type", F.lit(".v1"))
    head = F.format_string('{"specversion":"1.0","id":"%d","type":"%s","source":"/shop","subject":"s"', key, kind)
    plain = F.concat(head, F.lit(',"data":'), data, F.lit("}"))
    coded = F.concat(head, F.lit(',"data_base64":"'), F.base64(F.encode(data, "UTF-8")), F.lit('"}'))
    none = F.create_map().cast("map<string,string>")
    binary = F.create_map(
        F.lit("Ce-Id"), key.cast("string"), F.lit("Ce-Specversion"), F.lit("1.0"), F.lit("Ce-Type"), kind, F.lit("Ce-Source"), F.lit("/shop")
    )
    return t["events"].select(
        "event_id", F.when(key % 3 == 2, binary).otherwise(none).alias("headers"),
        F.when(key % 41 == 0, F.lit("[]")).when(key % 3 == 0, plain).when(key % 3 == 1, coded).otherwise(data).alias("body"),
    )


@query(
    "s26_cloud_events",
    """
    SELECT event_id, CASE WHEN event_id % 41 = 0 AND event_id % 3 <> 2 THEN 'invalid' WHEN event_type NOT IN ('purchase', 'view', 'error') THEN 'ignored'
                          WHEN event_id % 41 = 0 THEN 'invalid' ELSE 'ok' END AS state,
           CASE WHEN event_id % 41 <> 0 THEN user_id END AS user_id
    FROM {events}
    """,
)
def _(t):
    out = X.cloud_events(cloud_messages(t), ["shop.purchase.v1", "shop.v*", "shop.error.*"])
    return out.select("event_id", "state", variant_at(F.col("data"), "user", "bigint").alias("user_id"))


@query(
    "s26_cloud_event_match",
    "SELECT cast(event_id as varchar) AS id, concat('shop.', event_type, '.v1') AS type FROM {events} WHERE event_type = 'purchase' AND event_id % 41 <> 0",
)
def _(t):
    out = X.cloud_events(cloud_messages(t), ["shop.*"], match={"kind": "purchase"})
    return out.filter("state = 'ok'").select("id", "type")


@query(
    "s27_enrich_current",
    """
    SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 9 THEN c_mktsegment ELSE 'event' END AS segment
    FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey
    """,
)
def _(t):
    current = t["customer"].filter("c_custkey % 10 <> 9").select(
        F.col("c_custkey").cast("string").alias("customer"), F.struct(F.col("c_mktsegment").alias("segment")).alias("record")
    )
    events = t["orders"].select("o_orderkey", F.col("o_custkey").alias("customer"), F.struct(F.lit("event").alias("segment")).alias("payload"))
    return X.enrich(events, current, "customer").select("o_orderkey", "payload.segment")


@query(
    "s28_bulk_export",
    """SELECT cast(c_custkey as varchar) AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_mktsegment, ', "x"') END AS note FROM {customer}""",
)
def _(t):
    from flowlink.session import scratch

    path = scratch(t.spark, "export")
    key = F.col("c_custkey")
    rows = t["customer"].select(
        key.cast("string").alias("id"), F.col("c_name").alias("name"),
        F.when(key % 4 == 0, F.lit("")).otherwise(F.concat("c_mktsegment", F.lit(', "x"'))).alias("note"),
    )
    rows.write.csv(path, header=True, escape='"')
    return R.read_export(t.spark, path, ["id", "name", "note"], reported=t["customer"].count())


def order_nodes(t):
    """Orders as nodes of a graph API."""
    key = F.col("o_orderkey")

    def money(x):
        return F.struct(F.struct(x.cast("string").alias("amount")).alias("shopMoney"))

    line = F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("gid://shop/LineItem/"), F.when(i == 3, F.lit("x")).otherwise((key * 10 + i).cast("string"))).alias("id"),
        F.concat(F.lit("S"), i.cast("string")).alias("sku"), F.lit("thing").alias("name"), i.alias("quantity"),
        money(i * 2).alias("originalUnitPriceSet"),
    ))
    return t["orders"].select(
        key.cast("string").alias("legacyResourceId"), F.concat(F.lit("gid://shop/Order/"), key.cast("string")).alias("id"),
        F.when(key % 20 == 0, F.lit("draft")).otherwise(F.concat(F.lit("#SHOP-"), key.cast("string"))).alias("name"),
        F.lit("2026-01-01T00:00:00Z").alias("createdAt"), F.lit(None).cast("string").alias("updatedAt"),
        F.lit("a@b.example").alias("email"), F.lit("EUR").alias("currencyCode"),
        money(key).alias("subtotalPriceSet"), F.when(key % 2 == 0, money(key + 1)).alias("totalPriceSet"), money(F.lit(1)).alias("totalTaxSet"),
        F.col("o_orderstatus").alias("displayFinancialStatus"), F.lit(None).cast("string").alias("note"),
        F.when(key % 2 == 0, F.array(F.lit("a"), F.col("o_orderpriority"))).alias("tags"),
        F.when(key % 5 != 0, F.struct(
            F.col("o_custkey").cast("string").alias("legacyResourceId"), F.lit("c").alias("id"),
            F.struct(F.lit("x@y.example").alias("emailAddress")).alias("defaultEmailAddress"),
            F.lit("Ada").alias("firstName"), F.lit("L").alias("lastName"),
        )).alias("customer"),
        F.struct(F.array(F.struct(F.lit("std").alias("code"), F.lit("Post").alias("title"), money(F.lit(5)).alias("originalPriceSet"))).alias("nodes")).alias("shippingLines"),
        F.struct(line.alias("nodes")).alias("lineItems"),
    )


@query(
    "s29_order_normalization",
    """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 20 <> 0 THEN o_orderkey END AS order_number,
           CASE WHEN o_orderkey % 2 = 0 THEN cast(o_orderkey + 1 as varchar) ELSE '0.00' END AS total_price, lower(o_orderstatus) AS financial_status,
           CASE WHEN o_orderkey % 2 = 0 THEN concat('a, ', o_orderpriority) ELSE '' END AS tags,
           CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS customer_id, '5' AS shipping,
           cast(o_orderkey % 3 + 1 as integer) AS lines, o_orderkey * 10 + 1 AS first_line,
           CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey * 10 + o_orderkey % 3 + 1 END AS last_line
    FROM {orders}
    """,
)
def _(t):
    flat = R.normalize_orders(order_nodes(t))
    lines = F.col("line_items")
    return flat.select(
        "id", "order_number", "total_price", "financial_status", "tags", F.col("customer.id").alias("customer_id"),
        F.col("shipping_lines")[0]["price"].alias("shipping"), F.size(lines).alias("lines"),
        lines[0]["id"].alias("first_line"), F.element_at(lines, -1)["id"].alias("last_line"),
    )


_URI = T.StructType().add("uri", "string")
_DUE = T.StructType().add("__metadata", _URI).add("Due", "string")
ODATA = (
    T.StructType()
    .add("__metadata", _URI)
    .add("Number", "string")
    .add("Created", "string")
    .add("Changed", "string")
    .add("Partner", T.StructType().add("__deferred", _URI))
    .add("Items", T.StructType().add("results", T.ArrayType(_DUE)))
)


@query(
    "s30_odata_cleanup",
    """
    SELECT o_orderkey, concat('{"Number":"', cast(o_orderkey as varchar), '","Created":"', strftime(o_orderdate, '%Y-%m-%d'),
             '","Changed":"', strftime(o_orderdate + to_seconds(o_orderkey % 1000 + 1), '%Y-%m-%dT%H:%M:%SZ'),
             '","Items":[{"Due":"', strftime(o_orderdate, '%Y-%m-%d'), '"},{"Due":"soon"}]}') AS record
    FROM {orders}
    """,
)
def _(t):
    key, ms = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    text = F.format_string(
        '{"__metadata":{"uri":"u"},"Number":"%d","Created":"/Date(%d)/","Changed":"/Date(%d+0000)/","Partner":{"__deferred":{"uri":"p"}},'
        '"Items":{"results":[{"__metadata":{"uri":"i"},"Due":"/Date(%d)/"},{"Due":"soon"}]}}',
        key, ms, ms + (key % 1000 + 1) * 1000, ms,
    )
    out = R.clean_records(t["orders"].select("o_orderkey", text.alias("text")), "text", ODATA)
    return out.select("o_orderkey", F.to_json("record").alias("record"))
