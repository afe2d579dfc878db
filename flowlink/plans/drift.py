"""Catalog, drift and capacity queries. Objects are the parts of each brand and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlink.operators import drift as D
from flowlink.plans.mapping import shop_documents
from flowlink.plans.registry import derive, query

derive(
    "catalog_base",
    """
    SELECT p_brand AS endpoint, p_type AS object, p_type = 'ECONOMY' AS sampled, concat('f', cast(p_partkey as string)) AS field,
           CASE WHEN p_partkey % 5 = 0 THEN 'number' ELSE 'string' END AS type, cast(p_size % 7 * 10 as integer) AS length,
           p_partkey % 3 = 0 AS required, p_partkey % 4 = 0 AS read_only, p_partkey AS k
    FROM {part}
    """,
)
derive(
    "catalog_old",
    """
    SELECT endpoint, object, sampled, field, type, length, required, cast(NULL as string) AS required_by, read_only
    FROM {catalog_base} WHERE k % 11 <> 1 AND NOT (endpoint = 'Brand#3' AND object = 'PROMO')
    """,
)
derive(
    "catalog_new",
    """
    SELECT endpoint, object, sampled, field, CASE WHEN k % 13 = 2 THEN 'datetime' WHEN k % 13 = 3 THEN '' ELSE type END AS type,
           CASE WHEN k % 17 = 5 THEN cast(length / 2 as integer) WHEN k % 17 = 6 THEN 7 ELSE length END AS length,
           CASE WHEN k % 19 = 7 THEN NOT required ELSE required END AS required,
           CASE WHEN k % 19 = 7 AND NOT required THEN 'an operation' END AS required_by,
           CASE WHEN k % 23 = 8 THEN true ELSE read_only END AS read_only
    FROM {catalog_base} WHERE k % 11 <> 2 AND NOT (endpoint = 'Brand#5' AND object = 'STANDARD')
    """,
)
derive(
    "catalog_uses",
    """
    SELECT p_brand AS endpoint, p_type AS object, concat('f', cast(p_partkey as string)) AS field, concat('op', cast(p_partkey % 5 as string)) AS consumer, p_partkey % 16 = 0 AS creates
    FROM {part}
    UNION ALL SELECT p_brand, 'GONE', concat('f', cast(p_partkey as string)), 'op9', false FROM {part} WHERE p_partkey % 400 = 1
    """,
)
derive(
    "mappings",
    """
    SELECT p_brand AS endpoint, p_type AS object, concat('m', cast(p_partkey % 9 as string)) AS mapping, concat('t', cast(p_partkey as string)) AS target,
           concat('$lowercase(f', cast(p_partkey as string), ') & f', cast(p_partkey + 1 as string), '.code[0]') AS expression
    FROM {part}
    """,
)

derive(
    "workflow_maps",
    """
    SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN 'erp' ELSE p_brand END, '.', CASE WHEN p_partkey % 4 = 0 THEN 'Entity.x' ELSE p_type END) AS source,
           CASE WHEN p_partkey % 5 = 0 THEN 'elsewhere' ELSE p_brand END AS trigger_endpoint, concat('ev', cast(p_partkey % 7 as string)) AS trigger_event,
           concat('m', cast(p_partkey % 9 as string)) AS mapping, concat('t', cast(p_partkey as string)) AS target, concat('$trim(f', cast(p_partkey as string), ')') AS expression
    FROM {part}
    """,
)
derive("map_endpoints", "SELECT DISTINCT p_brand AS endpoint, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'erp' ELSE 'crm' END AS connector FROM {part}")
derive(
    "map_events",
    "SELECT p_brand AS endpoint, concat('ev', cast(p_partkey % 7 as string)) AS event, CASE WHEN p_partkey % 7 = 6 THEN 'GONE' ELSE min(p_type) END AS object FROM {part} GROUP BY p_brand, p_partkey % 7",
)

_KEYS = "o.endpoint = n.endpoint AND o.object = n.object"
DIFF = f"""
    oo AS (SELECT endpoint, object, bool_or(sampled) AS s FROM {{catalog_old}} GROUP BY endpoint, object),
    nn AS (SELECT endpoint, object, bool_or(sampled) AS s FROM {{catalog_new}} GROUP BY endpoint, object),
    kept AS (SELECT o.endpoint, o.object, o.s OR n.s AS sampled FROM oo o JOIN nn n ON {_KEYS}),
    f AS (SELECT coalesce(o.endpoint, n.endpoint) AS endpoint, coalesce(o.object, n.object) AS object, coalesce(o.field, n.field) AS field, o.type AS ot, n.type AS nt, o.length AS ol, n.length AS nl,
            o.required AS orq, n.required AS nrq, n.required_by AS why, o.read_only AS oro, n.read_only AS nro, o.field IS NULL AS added, n.field IS NULL AS gone
          FROM {{catalog_old}} o FULL JOIN {{catalog_new}} n ON {_KEYS} AND o.field = n.field),
    fk AS (SELECT f.*, sampled FROM f JOIN kept k ON k.endpoint = f.endpoint AND k.object = f.object),
    changes AS (
      SELECT endpoint, object, field, 'field-added' AS kind, NULL AS old, CASE WHEN why IS NOT NULL THEN concat_ws('; ', nullif(nt, ''), concat('required: ', why)) ELSE nt END AS new, nrq AS breaking FROM fk WHERE added
      UNION ALL SELECT endpoint, object, field, CASE WHEN sampled THEN 'field-not-seen' ELSE 'field-removed' END, ot, NULL, NOT sampled FROM fk WHERE gone
      UNION ALL SELECT endpoint, object, field, 'type-changed', ot, nt, true FROM fk WHERE NOT added AND NOT gone AND ot <> nt AND NOT (sampled AND (ot = '' OR nt = ''))
      UNION ALL SELECT endpoint, object, field, 'became-required', NULL, why, true FROM fk WHERE NOT added AND NOT gone AND nrq AND NOT orq
      UNION ALL SELECT endpoint, object, field, 'no-longer-required', NULL, NULL, false FROM fk WHERE NOT added AND NOT gone AND orq AND NOT nrq
      UNION ALL SELECT endpoint, object, field, 'length-shrunk', cast(ol as varchar), cast(nl as varchar), true FROM fk WHERE NOT added AND NOT gone AND nl > 0 AND (ol = 0 OR nl < ol)
      UNION ALL SELECT endpoint, object, field, 'became-read-only', NULL, NULL, true FROM fk WHERE NOT added AND NOT gone AND nro AND NOT oro
      UNION ALL SELECT o.endpoint, o.object, NULL, 'object-removed', NULL, NULL, true FROM oo o LEFT JOIN nn n ON {_KEYS} WHERE n.endpoint IS NULL
      UNION ALL SELECT n.endpoint, n.object, NULL, 'object-added', NULL, NULL, false FROM nn n LEFT JOIN oo o ON {_KEYS} WHERE o.endpoint IS NULL)
"""
USAGE = """
    usage AS (SELECT DISTINCT endpoint, object, field, consumer FROM {catalog_uses} UNION
      SELECT m.endpoint, m.object, c.field, printf('mapping %s (%s)', mapping, target) FROM (SELECT *, unnest(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM {mappings}) m
      JOIN (SELECT endpoint, object, field FROM {catalog_old} UNION SELECT endpoint, object, field FROM {catalog_new}) c ON c.endpoint = m.endpoint AND c.object = m.object AND c.field = word)
"""
MISSING = """
    objects AS (SELECT endpoint, object, bool_or(sampled) AS sampled FROM {catalog_new} GROUP BY endpoint, object),
    lack AS (SELECT u.endpoint, u.object, CASE WHEN o.endpoint IS NOT NULL THEN u.field END AS field, coalesce(o.sampled, false) AS sampled, u.consumer
      FROM {catalog_uses} u LEFT JOIN objects o ON o.endpoint = u.endpoint AND o.object = u.object
      LEFT JOIN {catalog_new} c ON c.endpoint = u.endpoint AND c.object = u.object AND c.field = u.field WHERE c.endpoint IS NULL),
    missing AS (SELECT endpoint, object, field, sampled, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS used_by FROM lack GROUP BY endpoint, object, field, sampled)
"""
ANNOTATED = f"""{DIFF}, {USAGE},
    fu AS (SELECT endpoint, object, field, list(DISTINCT consumer) AS users FROM usage GROUP BY endpoint, object, field),
    ou AS (SELECT endpoint, object, list(DISTINCT consumer) AS users FROM usage GROUP BY endpoint, object),
    cr AS (SELECT endpoint, object, list(DISTINCT consumer) AS makers FROM {{catalog_uses}} WHERE creates GROUP BY endpoint, object),
    annotated AS (SELECT *, breaking AND used_by <> '' AS breaks FROM (
      SELECT c.*, array_to_string(list_sort(list_distinct(list_concat(u, CASE WHEN breaking AND kind IN ('field-added', 'became-required') THEN list_transform(list_filter(coalesce(makers, []), lambda m: NOT list_contains(u, m)), lambda m: concat(m, ' (writes)')) ELSE [] END))), ',') AS used_by
      FROM (SELECT c.*, coalesce(CASE WHEN c.field IS NULL THEN ou.users ELSE fu.users END, []) AS u, makers FROM changes c
        LEFT JOIN fu ON fu.endpoint = c.endpoint AND fu.object = c.object AND fu.field = c.field
        LEFT JOIN ou ON ou.endpoint = c.endpoint AND ou.object = c.object LEFT JOIN cr ON cr.endpoint = c.endpoint AND cr.object = c.object) c))
"""


def changes(t):
    return D.diff(t["catalog_old"], t["catalog_new"])


def usage(t):
    old = D.field_usage(t["mappings"], t["catalog_old"], t["catalog_uses"])
    return D.union_usage(old, D.field_usage(t["mappings"], t["catalog_new"], t["catalog_uses"]))


def annotated(t):
    creators = t["catalog_uses"].filter("creates").select("endpoint", "object", "consumer")
    return D.annotate(changes(t), usage(t), creators)


@query(
    "d01_discover",
    """
    SELECT 'orders' AS object, f.field, f.type, f.n AS present FROM (
      SELECT 'order_number' AS field, 'bigint' AS type, count(*) AS n FROM {orders} UNION ALL SELECT 'created_at', 'string', count(*) FROM {orders}
      UNION ALL SELECT 'total', 'string', count(*) FROM {orders} UNION ALL SELECT 'currency', 'string', count(*) FILTER (o_orderkey % 3 <> 2) FROM {orders}
      UNION ALL SELECT 'customer.email', 'string', NULL UNION ALL SELECT 'customer.id', 'bigint', NULL UNION ALL SELECT 'items', 'array', count(*) FROM {orders}
      UNION ALL SELECT 'items[].sku', 'string', NULL UNION ALL SELECT 'items[].qty', 'bigint', NULL) f
    """,
)
def _(t):
    docs = shop_documents(t).select("order_number", "created_at", "total", "currency", "customer", "items")
    fields = D.discover(docs, "shop", "orders").select("object", "field", "type")
    return fields.join(D.filled(docs).select("field", "present"), "field", "left")


def declared_orders(t):
    """Orders with what a database declares of its columns."""
    said = {
        "o_orderkey": {"key": True}, "o_custkey": {"link": "customer.c_custkey"},
        "o_orderpriority": {"__CHAR_VARCHAR_TYPE_STRING": "varchar(15)"}, "o_totalprice": {"read_only": True},
    }
    return t["orders"].select(*[F.col(c).alias(c, metadata=said.get(c, {})) for c in t["orders"].columns])


@query(
    "d01_lengths_and_read_only",
    "SELECT field, length, read_only FROM (SELECT column_name AS field, cast(CASE column_name WHEN 'o_orderpriority' THEN 15 ELSE 0 END as integer) AS length, column_name = 'o_totalprice' AS read_only FROM (DESCRIBE SELECT * FROM {orders}))",
)
def _(t):
    return D.discover(declared_orders(t), "shop", "orders").select("field", "length", "read_only")


@query(
    "d01_keys_and_links",
    """SELECT column_name AS field, column_name = 'o_orderkey' AS key, CASE column_name WHEN 'o_custkey' THEN 'customer' END AS link_to, CASE column_name WHEN 'o_custkey' THEN 'c_custkey' END AS link_field
       FROM (DESCRIBE SELECT * FROM {orders}) WHERE column_name IN ('o_orderkey', 'o_custkey')""",
)
def _(t):
    return D.discover_links(declared_orders(t), "shop", "orders").drop("endpoint", "object")


@query("d02_diff_snapshots", f"WITH {DIFF} SELECT * FROM changes")
def _(t):
    return changes(t)


@query("j07_catalog_diff_counts", f"WITH {DIFF} SELECT kind, count(*) AS changes, count(*) FILTER (breaking) AS breaking FROM changes GROUP BY kind")
def _(t):
    return changes(t).groupBy("kind").agg(F.count(F.lit(1)).alias("changes"), F.count_if("breaking").alias("breaking"))


@query("j05_field_usage", f"WITH {USAGE} SELECT * FROM usage")
def _(t):
    return usage(t)


@query(
    "j05_usage_through_events",
    """
    WITH m AS (SELECT *, split_part(source, '.', 1) AS system, substr(source, instr(source, '.') + 1) AS entity FROM {workflow_maps}),
    obj AS (SELECT DISTINCT endpoint, object FROM {catalog_new}),
    o AS (SELECT m.*, e.endpoint, d.object AS direct FROM m JOIN {map_endpoints} e ON m.system = e.endpoint OR m.system = e.connector
          LEFT JOIN obj d ON d.endpoint = e.endpoint AND d.object = m.entity),
    r AS (SELECT endpoint, direct AS object, mapping, target, expression FROM o WHERE direct IS NOT NULL
          UNION ALL SELECT o.endpoint, v.object, mapping, target, expression FROM o JOIN {map_events} v ON v.endpoint = o.endpoint AND v.event = o.trigger_event
            JOIN obj x ON x.endpoint = v.endpoint AND x.object = v.object WHERE direct IS NULL AND trigger_endpoint = o.endpoint)
    SELECT DISTINCT r.endpoint, r.object, c.field, printf('mapping %s (%s)', mapping, target) AS consumer FROM r
    JOIN {catalog_new} c ON c.endpoint = r.endpoint AND c.object = r.object AND c.field = regexp_extract(expression, 'f[0-9]+')
    """,
)
def _(t):
    maps = D.mapped_objects(t["workflow_maps"], t["map_endpoints"], t["catalog_new"], t["map_events"])
    return D.field_usage(maps, t["catalog_new"], t["catalog_uses"].limit(0))


@query("u02_union_of_usage", f"WITH {USAGE} SELECT endpoint, object, field, count(*) AS users FROM usage GROUP BY endpoint, object, field")
def _(t):
    return usage(t).groupBy("endpoint", "object", "field").agg(F.count(F.lit(1)).alias("users"))


@query("j06_missing_uses", f"WITH {MISSING} SELECT * FROM missing")
def _(t):
    return D.missing_uses(t["catalog_uses"], t["catalog_new"]).withColumn("used_by", F.array_join("used_by", ","))


@query("d03_annotate_changes", f"WITH {ANNOTATED} SELECT endpoint, object, field, kind, breaking, used_by, breaks FROM annotated")
def _(t):
    return annotated(t).select("endpoint", "object", "field", "kind", "breaking", F.array_join("used_by", ",").alias("used_by"), "breaks")


@query(
    "l03_breaking_first",
    f"""WITH {ANNOTATED} SELECT endpoint, cast(row_number() OVER (PARTITION BY endpoint ORDER BY breaks DESC, object, field NULLS FIRST, kind) as integer) AS place, object, field, kind
        FROM annotated""",
)
def _(t):
    return D.sort_changes(annotated(t)).select("endpoint", "place", "object", "field", "kind")


@query(
    "d04_required_fields",
    """
    SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'email' WHEN 1 THEN 'iban' WHEN 2 THEN 'email,name' WHEN 3 THEN 'total' WHEN 4 THEN 'customer'
             WHEN 5 THEN '' WHEN 6 THEN 'vat' WHEN 7 THEN '' WHEN 8 THEN 'phone' WHEN 9 THEN 'country' WHEN 10 THEN 'deep,lost' ELSE '' END AS fields
    FROM {events}
    """,
)
def _(t):
    return D.required_fields(refusals(t)).select("event_id", F.array_join("fields", ",").alias("fields"))


# Fixed texts: what APIs answer when a field is missing, and two answers that teach nothing.
REFUSALS = [
    'crm: POST /contacts: HTTP 422: {"errors":{"email":["can\'t be blank"],"age":["is too low"]}}',
    'HTTP 400: {"error":{"param":"iban","code":"parameter_missing","type":"invalid_request"}}',
    'HTTP 422: {"errors":[{"field":"name","message":"is required"},{"field":"email.address","message":"must be provided"},{"field":"x","message":"bad"}]}',
    "HTTP 400: Missing required param: total",
    'HTTP 422: {"type":"about:blank","invalid-params":[{"name":"customer","reason":"must not be empty"}]}',
    'HTTP 500: {"errors":{"email":["can\'t be blank"]}}',
    "HTTP 400: the property vat is a required property",
    "the connection was reset",
    'HTTP 422: {"errors":[{"source":{"pointer":"/data/attributes/phone"},"detail":"cannot be blank"}]}',
    "HTTP 400: {\"message\":\"'country' is required\"}",
    'HTTP 422: {"a":[{"b":{"c":[[{"d":{"param":"deep","code":"missing_field"},"error":{"lost":["required"]}}]]}}]}',
    'HTTP 400: {"name":"ValidationError","message":"an email is required","errors":{"email":"is invalid"}}',
]


def refusals(t):
    texts = F.array(*[F.lit(x) for x in REFUSALS])
    return t["events"].select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.element_at(texts, (F.col("event_id") % len(REFUSALS) + 1).cast("int")).alias("error"),
    )


@query(
    "d04_learn_required",
    """
    WITH r AS (SELECT concat('Brand#', cast(user_id % 5 as varchar)) AS endpoint, min(strftime(ts, '%Y-%m-%d')) AS day, event_id % 12 AS k FROM {events} GROUP BY 1, 3),
    told AS (SELECT * FROM (VALUES (0, 'email'), (1, 'iban'), (2, 'email'), (2, 'name'), (3, 'total'), (4, 'customer'), (6, 'vat'), (8, 'phone'), (9, 'country'),
             (10, 'deep'), (10, 'lost')) v(k, field)),
    lessons AS (SELECT endpoint, field, min(day) AS day FROM r JOIN told ON told.k = r.k GROUP BY endpoint, field),
    sampled AS (SELECT DISTINCT endpoint FROM {catalog_new} WHERE sampled)
    SELECT l.endpoint, field, true AS required, concat('operation create was refused without it on ', day) AS required_by FROM lessons l JOIN sampled s ON s.endpoint = l.endpoint
    """,
)
def _(t):
    seen = refusals(t).select(
        F.concat(F.lit("Brand#"), (F.col("user_id") % 5).cast("string")).alias("endpoint"), F.lit("ECONOMY").alias("object"),
        F.lit("create").alias("operation"), "day", "error",
    )
    # The catalog's own fields are f and a number.
    return D.learn(t["catalog_new"], seen).filter(~F.col("field").rlike("^f[0-9]+$")).select("endpoint", "field", "required", "required_by")


@query(
    "d05_keep_required",
    """
    SELECT coalesce(n.endpoint, k.endpoint) AS endpoint, coalesce(n.object, k.object) AS object, coalesce(n.field, k.field) AS field,
           coalesce(n.required, false) OR k.field IS NOT NULL AS required, CASE WHEN n.field IS NULL THEN k.type ELSE n.type END AS type
    FROM {catalog_new} n FULL JOIN (SELECT * FROM {catalog_old} WHERE sampled AND required
      AND (endpoint, object) IN (SELECT (endpoint, object) FROM {catalog_new} WHERE sampled)) k ON k.endpoint = n.endpoint AND k.object = n.object AND k.field = n.field
    """,
)
def _(t):
    return D.keep_required(t["catalog_old"], t["catalog_new"]).select("endpoint", "object", "field", "required", "type")


@query(
    "d06_capacity",
    """
    WITH s AS (SELECT target, at_ms // 1000 AS sec, count(*) AS n FROM {writes_log} GROUP BY 1, 2), p AS (SELECT target, max(n) AS peak FROM s GROUP BY target),
    l AS (SELECT target, cast(substr(target, 2) as integer) * 0.5 + 1 AS lim FROM p)
    SELECT p.target, peak, cast(lim as double) AS "limit", CASE WHEN peak > lim THEN 'error' WHEN peak > lim * 0.8 THEN 'warning' ELSE 'ok' END AS level FROM p JOIN l ON l.target = p.target
    """,
)
def _(t):
    events = t["writes_log"].select("target", "at_ms")
    limits = events.select("target").distinct().withColumn("limit", F.substring("target", 2, 9).cast("int") * 0.5 + 1)
    return D.capacity(events, limits.withColumn("limit", F.col("limit").cast("double")))


@query(
    "a08_sample_schema",
    """
    SELECT event_type AS object, f.field, f.type FROM (SELECT DISTINCT event_type FROM {events}),
      (VALUES ('id', 'number'), ('when', 'datetime|string'), ('value', 'number|string'), ('flag', 'boolean'), ('nothing', ''), ('tags', 'array'), ('props', 'object')) f(field, type)
    """,
)
def _(t):
    key = F.col("event_id")
    text = F.concat(
        F.lit('{"id":'), key.cast("string"), F.lit(',"when":"'),
        F.when(key % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("later")), F.lit('","value":'),
        F.when(key % 3 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.col("value").cast("string")),
        F.lit(',"flag":true,"nothing":null,"tags":["a"],"props":'), F.col("props"), F.lit("}"),
    )
    docs = t["events"].select(F.col("event_type").alias("object"), text.alias("doc"))
    return D.sample_fields(docs, "doc", ["object"])


_FIELD_JSON = """concat('{"field":"', field, '","type":"', type, '","length":', cast(length as varchar), ',"required":', cast(required as varchar),
    CASE WHEN required_by IS NOT NULL THEN concat(',"required_by":"', required_by, '"') ELSE '' END, ',"read_only":', cast(read_only as varchar), '}', cast(sampled as varchar))"""


_DIGESTS = f"""
    SELECT endpoint, sha256(string_agg(concat(object, '=', d), chr(10) ORDER BY concat(object, '=', d))) AS digest, count(*) AS objects
    FROM (SELECT endpoint, object, sha256(string_agg({_FIELD_JSON}, chr(10) ORDER BY {_FIELD_JSON})) AS d FROM CATALOG GROUP BY endpoint, object) GROUP BY endpoint
"""


@query("a12_catalog_digest", _DIGESTS.replace("CATALOG", "{catalog_new}"))
def _(t):
    return D.digests(t["catalog_new"])


@query(
    "w04_snapshot_changes",
    """
    WITH c AS (SELECT concat('u', cast(user_id as varchar)) AS endpoint, event_id AS checked_at, event_type AS digest FROM {events}),
    n AS (SELECT *, CASE WHEN digest = lag(digest) OVER (PARTITION BY endpoint ORDER BY checked_at) THEN 0 ELSE 1 END AS fresh FROM c),
    s AS (SELECT *, cast(sum(fresh) OVER (PARTITION BY endpoint ORDER BY checked_at) as bigint) AS snapshot FROM n)
    SELECT endpoint, digest, min(checked_at) AS taken_at, max(checked_at) AS checked_at, count(*) AS checks FROM s GROUP BY endpoint, snapshot, digest
    """,
)
def _(t):
    checks = t["events"].select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("endpoint"), F.col("event_id").alias("checked_at"), F.col("event_type").alias("digest"))
    return D.snapshots(checks)


@query(
    "a10_system_overview",
    f"""
    WITH {ANNOTATED}, {MISSING}
    SELECT c.endpoint, c.objects, c.fields, CASE WHEN od.digest IS NULL OR od.digest = nd.digest THEN cast(1 as bigint) ELSE 2 END AS snapshots, coalesce(h.changes, 0) AS changes, coalesce(h.breaking, 0) AS breaking, coalesce(m.missing, 0) AS missing
    FROM (SELECT endpoint, count(DISTINCT object) AS objects, count(field) AS fields FROM {{catalog_new}} GROUP BY endpoint) c
    LEFT JOIN (SELECT endpoint, count(*) AS changes, count(*) FILTER (breaks) AS breaking FROM annotated GROUP BY endpoint) h ON h.endpoint = c.endpoint
    LEFT JOIN (SELECT endpoint, count(*) AS missing FROM missing GROUP BY endpoint) m ON m.endpoint = c.endpoint
    LEFT JOIN ({_DIGESTS.replace("CATALOG", "{catalog_old}")}) od ON od.endpoint = c.endpoint LEFT JOIN ({_DIGESTS.replace("CATALOG", "{catalog_new}")}) nd ON nd.endpoint = c.endpoint
    """,
)
def _(t):
    # The catalogs were checked in turn, the new one twice: an unchanged digest is no snapshot.
    checks = None
    for at, name in enumerate(("catalog_old", "catalog_new", "catalog_new")):
        check = D.digests(t[name]).select("endpoint", F.lit(at).cast("bigint").alias("checked_at"), "digest")
        checks = check if checks is None else checks.unionByName(check)
    counts = D.snapshots(checks).groupBy("endpoint").agg(F.count(F.lit(1)).alias("snapshots"))
    return D.overview(t["catalog_new"], counts, annotated(t), D.missing_uses(t["catalog_uses"], t["catalog_new"]))
