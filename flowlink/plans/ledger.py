"""Ledger, keyed-table, undo and plugin queries, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlink.functions import scalars as S
from flowlink.operators import ledger as L
from flowlink.operators import linking as X
from flowlink.operators import mapping as M
from flowlink.operators import plugins as G
from flowlink.operators import policy as P
from flowlink.plans.mapping import _DECISIONS, decided, shop_documents, sales_order_fields
from flowlink.plans.registry import derive, query

NOW = 1000  # the ledger's minute


def keyed(t, requests=None):
    """Requests with their store key; each eleventh is sent twice."""
    requests = t["requests"] if requests is None else requests
    r = requests.withColumn("attempt", F.lit(0))
    r = r.unionByName(requests.filter("run_id % 11 = 0").withColumn("attempt", F.lit(1)))
    order = F.col("run_id") * 2 + F.col("attempt")
    return r.withColumn("key", L.store_key(F.col("target"), F.col("operation"), F.col("idempotency_key"))).withColumn("arrived", order)


_LEDGER_STATE = """CASE WHEN l.status = 'done' THEN 'duplicate' WHEN l.status = 'inflight' AND 1000 - l.claimed_minute <= 5 THEN 'blocked'
                   WHEN r.attempt = 0 THEN 'write' ELSE 'duplicate' END"""
_KEYED = """(SELECT *, concat('erp/create-order/', idempotency_key) AS key, 0 AS attempt FROM {requests}
             UNION ALL SELECT *, concat('erp/create-order/', idempotency_key), 1 FROM {requests} WHERE run_id % 11 = 0)"""


@query(
    "k09_ledger_split",
    f"SELECT r.run_id, r.attempt, {_LEDGER_STATE} AS state FROM {_KEYED} r LEFT JOIN {{ledger}} l ON l.key = r.key",
)
def _(t):
    return L.split_requests(keyed(t), t["ledger"], NOW, "arrived").select("run_id", "attempt", F.col("ledger_state").alias("state"))


@query(
    "k09_requests_without_a_key",
    f"""
    SELECT r.run_id, r.attempt, CASE WHEN r.run_id % 5 = 0 THEN 'invalid' ELSE {_LEDGER_STATE} END AS state
    FROM {_KEYED} r LEFT JOIN {{ledger}} l ON l.key = r.key
    """,
)
def _(t):
    nameless = t["requests"].withColumn("idempotency_key", F.when(F.col("run_id") % 5 != 0, F.col("idempotency_key")))
    return L.split_requests(keyed(t, nameless), t["ledger"], NOW, "arrived").select("run_id", "attempt", F.col("ledger_state").alias("state"))


@query(
    "k09_complete_and_abort",
    f"""
    SELECT status, count(*) AS keys FROM (
      SELECT l.status FROM {{ledger}} l WHERE l.status = 'done' OR 1000 - l.claimed_minute <= 5
      UNION ALL SELECT 'done' FROM {_KEYED} r LEFT JOIN {{ledger}} l ON l.key = r.key WHERE {_LEDGER_STATE} = 'write' AND run_id % 4 <> 0)
    GROUP BY status
    """,
)
def _(t):
    wrote = L.split_requests(keyed(t), t["ledger"], NOW, "arrived").filter("ledger_state = 'write'")
    after = L.complete(t["ledger"], wrote.select("key", (F.col("run_id") % 4 != 0).alias("succeeded")), NOW)
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("keys"))


# --- Keyed tables: sales orders as a target system keeps them -----------------------------


def stored(t):
    return t["orders"].filter("o_orderkey % 3 <> 1").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("net_value"), F.lit("open").alias("status")
    )


def incoming(t):
    return t["orders"].filter("o_orderkey % 3 <> 2").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1).alias("customer"))


_STORED = "(SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS net_value, 'open' AS status FROM {orders} WHERE o_orderkey % 3 <> 1)"


@query(
    "k03_insert_if_absent",
    """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 1 THEN o_custkey ELSE o_custkey + 1 END AS customer,
           CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice ELSE 0.0 END AS net_value, CASE WHEN o_orderkey % 3 <> 1 THEN 'open' ELSE 'new' END AS status,
           o_orderkey % 3 = 1 AS inserted
    FROM {orders} WHERE o_orderkey % 3 <> 2
    """,
)
def _(t):
    return L.insert_absent(stored(t), incoming(t), "id", {"net_value": 0.0, "status": "new"})[1]


def updated(t):
    return L.update_by_key(stored(t), incoming(t), "id", {"status": "changed"})


@query(
    "k04_update_by_key",
    f"SELECT id, CASE WHEN id % 3 <> 2 THEN customer + 1 ELSE customer END AS customer, net_value, CASE WHEN id % 3 <> 2 THEN 'changed' ELSE status END AS status FROM {_STORED}",
)
def _(t):
    return updated(t).table


@query("k04_unknown_keys", "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 3 <> 2 AND o_orderkey % 3 = 1")
def _(t):
    return updated(t).unknown.select("id")


@query("k05_delete_by_key", f"SELECT id, net_value, id % 3 <> 2 AS deleted FROM {_STORED}")
def _(t):
    kept, deleted = L.delete_by_key(stored(t), incoming(t), "id")
    return kept.withColumn("deleted", F.lit(False)).unionByName(deleted.withColumn("deleted", F.lit(True))).select("id", "net_value", "deleted")


@query("k06_read_by_key", f"SELECT id, status FROM {_STORED} WHERE id % 3 <> 2")
def _(t):
    return L.read_by_key(stored(t), incoming(t), "id", ["status"])


@query(
    "k07_dry_run",
    f"""
    SELECT id, concat('{{"customer":', cast(customer as varchar), ',"status":"open"}}') AS current,
           concat('{{"customer":', cast(customer + 1 as varchar), ',"status":"changed"}}') AS proposed FROM {_STORED} WHERE id % 3 <> 2
    """,
)
def _(t):
    return L.preview(updated(t).changes)


@query("k08_confirm", "SELECT o_orderkey AS id FROM {orders} WHERE o_orderkey % 3 <> 2 AND o_orderkey % 3 = 1")
def _(t):
    return L.unconfirmed(incoming(t).select("id"), stored(t), "id")


@query("k14_capture_previous", f"SELECT id, customer AS was, customer + 1 AS now, 'open' AS was_status FROM {_STORED} WHERE id % 3 <> 2")
def _(t):
    return updated(t).changes.select(
        "id", F.col("previous.customer").alias("was"), F.col("applied.customer").alias("now"), F.col("previous.status").alias("was_status")
    )


@query("k14_restore_previous", f"SELECT * FROM {_STORED}")
def _(t):
    u = updated(t)
    return L.restore(u.table, u.changes, "id")


# --- Undo -------------------------------------------------------------------------------

derive(
    "saga_writes",
    """
    SELECT l_orderkey AS run_id, l_linenumber AS step, concat('t', cast(l_suppkey % 3 as string)) AS target,
           CASE WHEN l_partkey % 10 <> 0 THEN 'undo' END AS compensation,
           concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) AS idempotency_key,
           CASE WHEN l_partkey % 6 = 0 THEN 'duplicate' ELSE 'committed' END AS status
    FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)
    """,
)
_UNDONE = "concat(target, '/', compensation, '/', idempotency_key, '#compensate')"


@query(
    "k10_saga_undo_plan",
    """
    SELECT run_id, step, action, cast(row_number() OVER (PARTITION BY run_id ORDER BY step DESC) as integer) AS undo_order
    FROM (SELECT *, CASE WHEN compensation IS NULL THEN 'not undone' ELSE 'undo' END AS action FROM {saga_writes}
          WHERE status = 'committed' AND run_id % 4 = 1 AND (compensation IS NULL OR step <> 2))
    """,
)
def _(t):
    failed = t["orders"].filter("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("run_id"))
    writes = t["saga_writes"]
    key = F.concat(L.store_key(F.col("target"), F.col("compensation"), F.col("idempotency_key")), F.lit(L.COMPENSATE))
    # Second steps were compensated before.
    done = writes.filter("compensation IS NOT NULL AND step = 2").select(key.alias("key"), F.lit("done").alias("status"))
    return L.undo_plan(writes, failed, done).select("run_id", "step", "action", "undo_order")


@query(
    "w05_write_generations",
    """
    SELECT run_id, CASE WHEN run_id % 60 < 49 THEN cast(run_id % 60 + 1 as integer) END AS generation,
           CASE WHEN run_id % 60 = 0 THEN idempotency_key WHEN run_id % 60 < 49 THEN concat(idempotency_key, '~', cast(run_id % 60 + 1 as varchar)) END AS write_key,
           CASE WHEN run_id % 60 >= 49 THEN 'undone 49 times: the write needs another idempotency key' END AS write_error
    FROM {requests}
    """,
)
def _(t):
    # Order n was undone n % 60 times.
    times = F.explode(F.sequence(F.lit(1), (F.col("run_id") % 60).cast("int")))
    undone = t["requests"].filter("run_id % 60 > 0").select("*", times.alias("n"))
    name = F.when(F.col("n") == 1, F.col("idempotency_key")).otherwise(F.concat_ws("~", "idempotency_key", F.col("n").cast("string")))
    done = undone.select(
        F.concat(L.store_key(F.col("target"), F.col("compensation"), name), F.lit(L.COMPENSATE)).alias("key"), F.lit("done").alias("status")
    )
    return L.generations(t["requests"], done).select("run_id", "generation", "write_key", "write_error")


# --- Row pushes -------------------------------------------------------------------------


def pushed(t):
    docs = shop_documents(t).select(
        F.concat(F.lit("K"), F.col("order_number").cast("string")).alias("key"),
        S.project(F.col("items"), {"Material": "sku", "Quantity": "qty"}).alias("rows"),
    )
    return L.push_rows(docs, "rows", "key", "RowKey")


_ROWS = """(SELECT o_orderkey, i, concat('K', cast(o_orderkey as varchar)) AS key, concat('M-', cast((o_orderkey + i) % 2000 as varchar)) AS "Material", cast(i + 1 as bigint) AS "Quantity",
             CASE WHEN o_orderkey % 4 = 0 THEN concat('K', cast(o_orderkey as varchar)) ELSE concat('K', cast(o_orderkey as varchar), '/', cast(i + 1 as varchar)) END AS "RowKey"
            FROM (SELECT o_orderkey, unnest(range(o_orderkey % 4 + 1)) AS i FROM {orders}))"""


@query("k11_push_rows", f'SELECT key, "Material", "Quantity", "RowKey", 0 AS batch FROM {_ROWS}')
def _(t):
    return pushed(t)


@query(
    "k11_large_payloads",
    """
    WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice) - 1 AS i, l_suppkey % 3 AS payload FROM {lineitem})
    SELECT concat('P', cast(payload as varchar)) AS key, cast(i // 10000 as integer) AS batch, count(*) AS "rows", concat('P', cast(payload as varchar), '/', cast(min(i) + 1 as varchar)) AS first_key
    FROM r GROUP BY payload, i // 10000
    """,
)
def _(t):
    key = F.concat(F.lit("P"), (F.col("l_suppkey") % 3).cast("string")).alias("key")
    payloads = t["lineitem"].groupBy(key).agg(F.collect_list(F.struct(F.col("l_orderkey").alias("Order"))).alias("rows"))
    rows = L.push_rows(payloads, "rows", "key", "RowKey")
    place = F.split_part("RowKey", F.lit("/"), F.lit(2)).cast("bigint")
    counted = rows.groupBy("key", "batch").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first"))
    return counted.select("key", "batch", "rows", F.concat_ws("/", "key", F.col("first").cast("string")).alias("first_key"))


@query(
    "k12_reverse_rows",
    f"""SELECT "Material", cast(0 as bigint) AS net, 2 * count(*) AS pushed, count(*) AS reversed FROM {_ROWS} GROUP BY "Material" """,
)
def _(t):
    rows = pushed(t).withColumn("Reversal", F.lit(False))
    both = rows.unionByName(L.reverse_rows(rows, ["Quantity"], {"Reversal": True}, "RowKey"))
    return both.groupBy("Material").agg(
        F.sum("Quantity").alias("net"), F.count(F.lit(1)).alias("pushed"), F.count_if(F.col("RowKey").endswith(L.REVERSED)).alias("reversed")
    )


# --- Plugins ----------------------------------------------------------------------------


def credit_tables(t):
    limit = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 50)
    customers = t["customer"].select(F.col("c_custkey").alias("customer_id"), "c_name", limit.alias("credit_limit"))
    scores = t["customer"].filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 100).alias("score"))
    orders = t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("net_value"))
    return {"orders": orders, "customers": customers, "scores": scores}


_CREDIT = """CASE WHEN c_acctbal > 0 AND o_totalprice <= c_acctbal * 50 AND (c_custkey % 4 = 0 OR c_custkey % 100 >= 50) THEN 'approved' ELSE 'review' END"""


@query("j09_credit_check", f"SELECT o_orderkey AS order_id, {_CREDIT} AS credit_status FROM {{orders}} LEFT JOIN {{customer}} ON c_custkey = o_custkey")
def _(t):
    tables = credit_tables(t)
    return G.credit_check(tables["orders"], tables["customers"], tables["scores"]).select("order_id", "credit_status")


@query(
    "x01_logic_plugin",
    f"""SELECT 'SalesOrder' AS entity, cast(o_orderkey as varchar) AS record_id, concat('{{"creditStatus":"', {_CREDIT}, '"}}') AS patch
        FROM {{orders}} LEFT JOIN {{customer}} ON c_custkey = o_custkey""",
)
def _(t):
    def plugin(tables):
        checked = G.credit_check(tables["orders"], tables["customers"], tables["scores"])
        patch = F.to_json(F.struct(F.col("credit_status").alias("creditStatus")))
        return checked.select(F.lit("SalesOrder").alias("entity"), F.col("order_id").cast("string").alias("record_id"), patch.alias("patch"))

    grants = {"orders": ["order_id", "customer_id", "net_value"], "customers": ["customer_id", "credit_limit"], "scores": ["customer_id", "score"]}
    return G.run_plugin(plugin, credit_tables(t), grants)


@query("x02_field_grants", "SELECT c_custkey AS customer_id, CASE WHEN c_acctbal > 0 THEN c_acctbal * 50 END AS credit_limit FROM {customer}")
def _(t):
    return G.granted(credit_tables(t), {"customers": ["customer_id", "credit_limit"]})["customers"]


# --- Flagship ---------------------------------------------------------------------------


@query(
    "governed_order_writes",
    f"""
    WITH line AS (SELECT l_orderkey, count(*) AS n FROM {{lineitem}} GROUP BY l_orderkey),
    d AS (SELECT run_id, allow, denied, must_approve, require_approval FROM ({_DECISIONS}))
    SELECT status, currency, count(*) AS orders, cast(sum(lines) as bigint) AS lines, cast(sum(cents) as bigint) AS cents FROM (
      SELECT CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency, coalesce(n, 0) AS lines, CASE WHEN o_orderkey % 17 <> 0 THEN cast(round(o_totalprice * 100) as bigint) ELSE 0 END AS cents,
        CASE WHEN o_orderkey % 17 = 0 THEN 'invalid' WHEN x.master_id IS NULL THEN 'unresolved'
             WHEN l.status = 'done' THEN 'duplicate' WHEN l.status = 'inflight' AND 1000 - l.claimed_minute <= 5 THEN 'blocked'
             WHEN denied OR (NOT allow AND NOT (must_approve OR require_approval)) THEN 'denied' WHEN must_approve OR require_approval THEN 'needs_approval' ELSE 'ready' END AS status
      FROM {{orders}} JOIN d ON d.run_id = o_orderkey LEFT JOIN line ON l_orderkey = o_orderkey
      LEFT JOIN {{xref}} x ON x.source_id = cast(o_custkey as varchar) AND x.system = 'shop'
      LEFT JOIN {{ledger}} l ON l.key = concat('erp/create-order/ORD-', cast(o_orderkey as varchar)))
    GROUP BY status, currency
    """,
)
def governed_order_writes(t):
    """Order documents mapped, resolved, put to policy and to the ledger; counts by outcome.

    Lines are counted per order before they meet the documents; everything after the joins
    is one pass.
    """
    fields = sales_order_fields() + [M.Field("ref", F.col("customer.id").cast("string"))]
    docs = M.apply_mapping(shop_documents(t), fields, keep=["order_number"])
    lines = t["lineitem"].groupBy(F.col("l_orderkey").alias("order_number")).agg(F.count(F.lit(1)).alias("line_count"))
    requests = decided(t).withColumn("admission", P.admission(F.col("decision"), F.col("require_approval")))
    requests = requests.select(
        F.col("run_id").alias("order_number"), "admission", "run_id",
        L.store_key(F.col("target"), F.col("operation"), F.col("idempotency_key")).alias("key"),
    )
    resolved = X.resolve_exact(docs, t["xref"], "Customer", "shop", "ref", "customerId")
    joined = resolved.join(requests, "order_number").join(lines, "order_number", "left")
    split = L.split_requests(joined, t["ledger"], NOW, "run_id")
    status = (
        F.when(F.size("_errors") > 0, "invalid")
        .when(F.col("customerId").isNull(), "unresolved")
        .when(F.col("ledger_state") != "write", F.col("ledger_state"))
        .otherwise(F.col("admission"))
    )
    cents = F.coalesce(F.round(F.col("netValue") * 100).cast("bigint"), F.lit(0))
    return split.groupBy(status.alias("status"), "currency").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.coalesce("line_count", F.lit(0))).alias("lines"), F.sum(cents).alias("cents")
    )
