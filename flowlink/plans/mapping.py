"""Mapping, scalar, document and policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.functions import documents as D
from flowlink.functions import scalars as S
from flowlink.operators import mapping as M
from flowlink.operators import policy as P
from flowlink.plans.registry import Tables, query


def shop_documents(t: Tables) -> DataFrame:
    """One nested shop order per order: its customer, and one to four items."""
    key = F.col("o_orderkey")
    return t["orders"].select(
        key.alias("order_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(key % 17 == 0, F.lit("n/a")).otherwise(S.string(F.col("o_totalprice"), "double")).alias("total"),
        F.when(key % 3 == 0, F.lit("eur")).when(key % 3 == 1, F.lit("usd")).alias("currency"),
        F.struct(
            F.concat(F.lit("U"), F.col("o_custkey").cast("string"), F.lit("@Shop.Example")).alias("email"),
            F.col("o_custkey").alias("id"),
        ).alias("customer"),
        F.transform(
            F.sequence(F.lit(0), (key % 4).cast("int")),
            lambda i: F.struct(
                F.concat(F.lit("M-"), ((key + i) % 2000).cast("string")).alias("sku"),
                (i + 1).cast("bigint").alias("qty"),
            ),
        ).alias("items"),
        F.col("o_totalprice"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


def sales_order_fields() -> list[M.Field]:
    """The mapping shop order -> sales order."""
    c = F.col
    return [
        M.Field("externalId", S.join_text("SHOP-", S.string(c("order_number")))),
        M.Field("customerRef", S.lowercase(c("customer.email"))),
        M.Field("orderDate", S.substring(c("created_at"), 0, 10)),
        M.Field("netValue", S.number(c("total")), S.number_fails(c("total"))),
        M.Field("currency", S.uppercase(c("currency"))),
        M.Field("lines", S.project(c("items"), {"material": "sku", "quantity": "qty"})),
    ]


# Numbers in these tables have two decimals: their JSON text drops trailing zeros.
_TEXT = "regexp_replace(regexp_replace(cast(cast({c} as decimal(18,2)) as varchar), '0+$', ''), '\\.$', '')"
TOTAL = _TEXT.format(c="o_totalprice")
ITEMS = "(o_orderkey % 4 + 1)"


@query(
    "p01_apply_mapping",
    f"""
    SELECT o_orderkey AS order_number, concat('SHOP-', cast(o_orderkey as varchar)) AS "externalId",
           concat('u', cast(o_custkey as varchar), '@shop.example') AS "customerRef",
           strftime(o_orderdate, '%Y-%m-%d') AS "orderDate",
           CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS "netValue",
           CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency,
           concat('M-', cast(o_orderkey % 2000 as varchar)) AS first_material, {ITEMS} AS line_count
    FROM {{orders}}
    """,
)
def _(t):
    mapped = M.apply_mapping(shop_documents(t), sales_order_fields(), keep=["order_number"])
    return mapped.select(
        "order_number", "externalId", "customerRef", "orderDate", "netValue", "currency",
        F.col("lines")[0]["material"].alias("first_material"),
        F.size("lines").cast("bigint").alias("line_count"),
    )


@query(
    "p02_mapping_failures",
    "SELECT o_orderkey AS order_number, 'netValue' AS failed FROM {orders} WHERE o_orderkey % 17 = 0",
)
def _(t):
    mapped = M.apply_mapping(shop_documents(t), sales_order_fields(), keep=["order_number"])
    _, bad = M.split_failures(mapped)
    return bad.select("order_number", F.array_join("_errors", ",").alias("failed"))


@query(
    "p03_omit_undefined",
    """
    SELECT o_orderkey AS order_number,
           concat('{', CASE o_orderkey % 3 WHEN 0 THEN '"currency":"EUR",' WHEN 1 THEN '"currency":"USD",' ELSE '' END,
                  '"externalId":"SHOP-', cast(o_orderkey as varchar), '"}') AS document
    FROM {orders}
    """,
)
def _(t):
    fields = [f for f in sales_order_fields() if f.target in ("currency", "externalId")]
    mapped = M.apply_mapping(shop_documents(t), fields, keep=["order_number"], checked=False)
    return mapped.select("order_number", M.document_json(mapped, ["currency", "externalId"]).alias("document"))


@query(
    "p04_equality_filter",
    "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def _(t):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    return t["orders"].filter(D.equality_filter(wanted)).select("o_orderkey")


@query(
    "p05_path_filter",
    """SELECT event_id FROM {events} WHERE json_extract_string(props, '$.k') = '69'""",
)
def _(t):
    doc = t["events"].withColumn("doc", F.try_parse_json("props"))
    return doc.filter(D.path_filter(F.col("doc"), {"k": "69"})).select("event_id")


@query(
    "p06_path_lookup",
    f"""
    SELECT o_orderkey, concat('M-', cast(o_orderkey % 2000 as varchar)) AS first_sku,
           CASE WHEN {ITEMS} >= 2 THEN 2 END AS second_qty,
           concat('U', cast(o_custkey as varchar), '@Shop.Example') AS email, cast(NULL as varchar) AS missing
    FROM {{orders}}
    """,
)
def _(t):
    docs = shop_documents(t).select("order_number", F.to_variant_object(F.struct("customer", "items")).alias("doc"))
    doc = F.col("doc")
    return docs.select(
        F.col("order_number").alias("o_orderkey"),
        D.variant_at(doc, "items.0.sku").alias("first_sku"),
        D.variant_at(doc, "items.1.qty", "int").alias("second_qty"),
        D.variant_at(doc, "customer.email").alias("email"),
        D.variant_at(doc, "customer.phone.home").alias("missing"),
    )


@query(
    "p07_key_template",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN concat('order/', cast(o_orderkey as varchar), '/',
             CASE o_orderkey % 3 WHEN 0 THEN 'eur' ELSE 'usd' END, '/', {TOTAL}) END AS key,
           CASE WHEN o_orderkey % 3 = 2 THEN 'unresolved source.currency' END AS key_error
    FROM {{orders}}
    """,
)
def _(t):
    docs = shop_documents(t).select(
        "order_number", F.struct("order_number", "currency").alias("payload"), F.struct(F.col("o_totalprice").alias("net")).alias("doc")
    )
    out = D.render(
        docs, "order/{{ source.order_number }}/{{ source.currency }}/{{ doc.net }}", {"source": "payload", "doc": "doc"}
    )
    return out.select(F.col("order_number").alias("o_orderkey"), "key", "key_error")


@query(
    "p08_snake_case",
    """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS net_value, 'open' AS status,
           'net_value,customer_id,iban2_code,url' AS names
    FROM {orders}
    """,
)
def _(t):
    camel = t["orders"].select(
        F.col("o_orderkey").alias("orderId"), F.col("o_custkey").alias("customerID"), F.col("o_totalprice").alias("netValue"),
        F.col("o_orderstatus").alias("status"),
    )
    names = F.array(*[F.lit(n) for n in ("netValue", "customerID", "iban2Code", "URL")])
    return D.snake_columns(camel, {"status": "open"}).withColumn(
        "names", F.array_join(F.transform(names, D.snake_text), ",")
    )


@query(
    "p09_nest_fields",
    """
    SELECT o_orderkey, concat('{"payment":{"a.b":"x","meta":{"currency":"', CASE o_orderkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'usd' ELSE '-' END,
           '","order":', cast(o_orderkey as varchar), '}}}') AS body
    FROM {orders}
    """,
)
def _(t):
    body = D.nest(
        {"meta.order": F.col("order_number"), "meta.currency": F.coalesce("currency", F.lit("-")), "a\\.b": F.lit("y")},
        constants={"a\\.b": "x"},
        wrap="payment",
    )
    return shop_documents(t).select(F.col("order_number").alias("o_orderkey"), F.to_json(body).alias("body"))


@query(
    "p10_version_id",
    """
    SELECT event_id, concat(cast(event_id as varchar), '@', cast(user_id as varchar)) AS version,
           cast(event_id as varchar) AS record, user_id AS position, concat(event_type, '@x') AS plain
    FROM {events}
    """,
)
def _(t):
    v = t["events"].withColumn("version", D.version_id(F.col("event_id"), F.col("user_id")))
    return v.select(
        "event_id", "version", D.record_id(F.col("version")).alias("record"),
        D.record_position(F.col("version")).alias("position"),
        D.record_id(F.concat("event_type", F.lit("@x"))).alias("plain"),
    )


@query(
    "p11_step_output",
    """
    SELECT o_orderkey, concat('{"id":', cast(o_orderkey as varchar), ',"result":{"number":"ERP-', cast(o_orderkey + 7 as varchar), '"}}') AS document
    FROM {orders}
    """,
)
def _(t):
    doc = t["orders"].select(F.col("o_orderkey").alias("id"))
    out = M.with_output(doc, "result", F.struct(F.concat(F.lit("ERP-"), (F.col("id") + 7).cast("string")).alias("number")))
    return out.select(F.col("id").alias("o_orderkey"), F.to_json(F.struct("id", "result")).alias("document"))


@query(
    "p12_amount",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey END AS by_name,
           CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_totalprice END AS by_path
    FROM {orders}
    """,
)
def _(t):
    docs = shop_documents(t).select(
        "order_number",
        F.lit("12.50").alias("netValue"),
        F.when(F.col("order_number") % 2 == 0, F.col("o_totalprice")).alias("amount"),
        F.col("customer.id").alias("totalAmount"),
        F.struct(F.concat(F.lit(" "), F.col("total")).alias("net")).alias("totals"),
    )
    return docs.select(
        F.col("order_number").alias("o_orderkey"),
        M.amount_of(docs).alias("by_name"),
        M.amount_of(docs, "totals.net").alias("by_path"),
    )


def decided(t: Tables) -> DataFrame:
    """Requests with their policy decision."""
    roles = F.array_compact(
        F.array(F.when(F.col("is_operator"), F.lit(P.OPERATOR)), F.when(F.col("is_reader"), F.lit(P.READER)))
    )
    return t["requests"].withColumn(
        "decision", P.decide(F.col("risk"), roles, F.col("agent"), F.col("amount"), F.col("approval"))
    )


_DECISIONS = """
    SELECT *, CASE WHEN denied THEN false ELSE base END AS allow FROM (
      SELECT *, coalesce(approval = 'rejected', false) OR (agent AND risk IN ('low', 'high') AND NOT is_operator) AS denied,
             CASE risk WHEN 'read' THEN is_operator OR is_reader WHEN 'low' THEN is_operator
                       WHEN 'high' THEN coalesce(approval = 'approved', false) ELSE false END AS base,
             risk = 'high' OR amount > 50000 AS must_approve
      FROM {requests})
"""


@query(
    "p13_policy_decision",
    f"""
    SELECT run_id, allow, must_approve AS require_approval, denied,
           concat_ws('; ', CASE WHEN risk = 'high' THEN 'high-risk tool' WHEN risk = 'odd' THEN 'unknown risk tier odd' END,
             CASE WHEN amount > 50000 THEN 'amount above approval threshold' END,
             CASE WHEN agent AND risk IN ('low', 'high') AND NOT is_operator THEN 'agents need the integration-operator role to write' END,
             CASE WHEN approval = 'rejected' THEN 'approval rejected' END) AS reasons
    FROM ({_DECISIONS})
    """,
)
def _(t):
    return decided(t).select(
        "run_id", "decision.allow", "decision.require_approval", "decision.denied",
        F.array_join("decision.reasons", "; ").alias("reasons"),
    )


_ADMISSION = """CASE WHEN denied OR (NOT allow AND NOT (must_approve OR require_approval)) THEN 'denied'
                WHEN must_approve OR require_approval THEN 'needs_approval' ELSE 'ready' END"""


@query("p14_write_admission", f"SELECT run_id, {_ADMISSION} AS state FROM ({_DECISIONS})")
def _(t):
    return decided(t).select("run_id", P.admission(F.col("decision"), F.col("require_approval")).alias("state"))


@query(
    "p15_amount_reconciliation",
    """
    WITH shown AS (SELECT l_orderkey, round(sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) / 100.0, 2) AS total
                   FROM {lineitem} GROUP BY l_orderkey)
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 11 = 3 THEN printf('amount %.2f not compared: there was no dry run', o_totalprice)
                WHEN o_orderkey % 11 = 5 THEN printf('amount %.2f not compared: the dry run is no JSON', o_totalprice)
                WHEN total IS NULL OR o_orderkey % 11 = 7 THEN printf('amount %.2f not compared: the dry run has no amount at totals.net', o_totalprice)
                WHEN abs(total - o_totalprice) > greatest(0.25 * abs(o_totalprice), 0.005)
                THEN printf('the dry run has %.2f at totals.net, the request %.2f', total, o_totalprice) END AS why
    FROM {orders} LEFT JOIN shown ON l_orderkey = o_orderkey
    """,
)
def _(t):
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint")
    shown = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum(cents) / 100.0).alias("total"))
    joined = t["orders"].select("o_orderkey", "o_totalprice").join(shown, "o_orderkey", "left")
    # Dry runs as targets give them: numbers or texts, other shapes, no JSON, none at all.
    k, total = F.col("o_orderkey") % 11, F.round("total", 2).cast("decimal(18,2)").cast("string")
    amount = F.when(F.col("o_orderkey") % 2 == 0, total).otherwise(F.concat(F.lit('"'), total, F.lit('"')))
    preview = F.when(k == 5, "<html>").when(k == 7, '{"totals":[1]}').when(k != 3, F.concat(F.lit('{"totals":{"net":'), F.coalesce(amount, F.lit("null")), F.lit("}}")))
    why = P.amount_mismatch(F.col("o_totalprice"), preview, "totals.net", 0.25)
    return joined.select("o_orderkey", why.alias("why"))


@query(
    "p16_mask_personal",
    """SELECT id, CASE WHEN email IS NOT NULL THEN '***' END AS email, name, master_id FROM {people}""",
)
def _(t):
    return P.mask_personal(t["people"].select("id", "email", "name", "master_id"), "preview")


def sink_rows(t: Tables) -> DataFrame:
    """Sales rows as text; each seventeenth has a bad number, date and an unknown column."""
    bad = F.col("o_orderkey") % 17 == 0
    return t["orders"].select(
        "o_orderkey",
        F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("OrderId"),
        F.when(bad, F.lit("1998-13-40")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("OrderDate"),
        S.string(F.col("o_totalprice"), "double").alias("NetValue"),
        F.when(F.col("o_orderkey") % 34 == 0, F.lit("2.5")).otherwise(F.lit(" 3.0 ")).alias("Lines"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("TRUE")).otherwise(F.lit("no")).alias("Reversal"),
        F.when(F.col("o_orderkey") % 51 == 0, F.lit("x")).alias("Extra"),
    )


SINK_TYPES = {"OrderId": "String", "OrderDate": "DateTime", "NetValue": "Double", "Lines": "Int64", "Reversal": "Boolean"}


@query(
    "p17_row_validation",
    """
    SELECT o_orderkey, concat('O-', cast(o_orderkey as varchar)) AS "OrderId",
           CASE WHEN o_orderkey % 17 <> 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00') END AS "OrderDate",
           o_totalprice AS "NetValue", CASE WHEN o_orderkey % 34 <> 0 THEN cast(3 as bigint) END AS "Lines",
           CASE WHEN o_orderkey % 5 = 0 THEN true END AS "Reversal",
           concat_ws('; ', CASE WHEN o_orderkey % 17 = 0 THEN 'column OrderDate must be DateTime (ISO 8601)' END,
             CASE WHEN o_orderkey % 34 = 0 THEN 'column Lines must be Int64' END,
             CASE WHEN o_orderkey % 5 <> 0 THEN 'column Reversal must be Boolean' END,
             CASE WHEN o_orderkey % 51 = 0 THEN 'column Extra is not in the table' END) AS errors
    FROM {orders}
    """,
)
def _(t):
    checked = P.check_rows(sink_rows(t), SINK_TYPES, keep=["o_orderkey"])
    return checked.withColumn("errors", F.array_join("_errors", "; ")).drop("_errors")


@query(
    "p18_currency_scaling",
    """
    WITH o AS (SELECT o_orderkey, cast(o_totalprice as decimal(18,2)) AS amount,
                 CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'JPY' ELSE 'kwd' END AS currency FROM {orders})
    SELECT o_orderkey, currency,
           CASE currency WHEN 'EUR' THEN cast(amount * 100 as bigint) WHEN 'kwd' THEN cast(amount * 1000 as bigint)
                WHEN 'JPY' THEN CASE WHEN amount = floor(amount) THEN cast(amount as bigint) END END AS minor,
           cast(CASE currency WHEN 'EUR' THEN o_orderkey / 100.0 WHEN 'kwd' THEN o_orderkey / 1000.0 ELSE o_orderkey END as double) AS major
    FROM o
    """,
)
def _(t):
    key = F.col("o_orderkey")
    currency = F.when(key % 3 == 0, F.lit("EUR")).when(key % 3 == 1, F.lit("JPY")).otherwise(F.lit("kwd"))
    o = t["orders"].select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), currency.alias("currency"))
    return o.select(
        "o_orderkey", "currency",
        P.to_minor(F.col("amount"), F.col("currency")).alias("minor"),
        P.to_major(key, F.col("currency")).cast("double").alias("major"),
    )


@query(
    "p19_classify_failures",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'denied' WHEN event_type = 'view' THEN 'rejected'
                          WHEN event_type = 'click' AND event_id % 3 < 2 THEN 'invalid' ELSE 'retryable' END AS outcome
    FROM {events}
    """,
)
def _(t):
    e = t["events"]
    kind = F.when(F.col("event_type") == "error", "denied").when(F.col("event_type") == "view", "rejected").when(
        F.col("event_type") == "signup", "timeout"
    )
    state = F.when(
        F.col("event_type") == "click",
        F.element_at(F.array(F.lit("22003"), F.lit("23505"), F.lit("40001")), (F.col("event_id") % 3 + 1).cast("int")),
    )
    return e.select("event_id", P.classify_failure(kind, state).alias("outcome"))


# --- Mapping expressions ---------------------------------------------------------------


def _expressions(t: Tables, **columns) -> DataFrame:
    return shop_documents(t).select(F.col("order_number").alias("o_orderkey"), *[c.alias(n) for n, c in columns.items()])


@query(
    "f01_number",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS v, o_orderkey % 17 = 0 AS failed FROM {orders}",
)
def _(t):
    return _expressions(t, v=S.number(F.col("total")), failed=S.number_fails(F.col("total")))


@query("f02_string", f"SELECT o_orderkey, cast(o_orderkey as varchar) AS whole, {TOTAL} AS price FROM {{orders}}")
def _(t):
    return _expressions(t, whole=S.string(F.col("order_number")), price=S.string(F.col("o_totalprice"), "double"))


@query(
    "f03_substring",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m') AS month, 'Z' AS tail FROM {orders}",
)
def _(t):
    c = F.col("created_at")
    return _expressions(t, day=S.substring(c, 0, 10), month=S.substring(c, 5, 2), tail=S.substring(c, -1))


@query(
    "f04_substring_before_after",
    """
    SELECT o_orderkey, concat('U', cast(o_custkey as varchar)) AS before_at, 'Shop.Example' AS after_at,
           substr(o_orderpriority, 3) AS after_dash, o_orderpriority AS no_mark
    FROM {orders}
    """,
)
def _(t):
    email = F.col("customer.email")
    return _expressions(
        t, before_at=S.substring_before(email, "@"), after_at=S.substring_after(email, "@"),
        after_dash=S.substring_after(F.col("priority"), "-"), no_mark=S.substring_after(F.col("priority"), "#"),
    )


@query(
    "f05_case_and_trim",
    """
    SELECT o_orderkey, lower(o_orderpriority) AS low, upper(concat('u', o_orderstatus)) AS up,
           concat('x ', o_orderpriority, ' y') AS trimmed
    FROM {orders}
    """,
)
def _(t):
    return _expressions(
        t, low=S.lowercase(F.col("priority")), up=S.uppercase(F.concat(F.lit("u"), F.col("status"))),
        trimmed=S.trim(F.concat(F.lit(" x \t "), F.col("priority"), F.lit("\n y "))),
    )


@query(
    "f06_concatenate",
    """SELECT o_orderkey, concat('[', CASE o_orderkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'usd' ELSE '' END, ':', cast(o_orderkey as varchar), ']') AS v FROM {orders}""",
)
def _(t):
    return _expressions(t, v=S.join_text("[", F.col("currency"), ":", F.col("order_number"), "]"))


@query(
    "f07_conditional",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'euro' ELSE 'other' END AS v FROM {orders}""",
)
def _(t):
    return _expressions(t, v=S.choose(S.equals(F.col("currency"), "eur"), "euro", "other"))


@query(
    "f08_arithmetic",
    """SELECT o_orderkey, round(o_totalprice * 2, 4) AS doubled, round(o_totalprice / nullif(o_orderkey % 5, 0), 4) AS share FROM {orders}""",
)
def _(t):
    price = F.col("o_totalprice")
    return _expressions(
        t, doubled=F.round(S.multiply(price, 2), 4), share=F.round(S.divide(price, F.col("order_number") % 5), 4)
    )


@query(
    "f09_round",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey / 4
             WHEN (o_orderkey * 25) % 100 = 50 THEN 2 * round(cast(o_orderkey as double) / 8)
             ELSE round(o_orderkey / 4.0) END AS v
    FROM {orders}
    """,
)
def _(t):
    return _expressions(t, v=S.rounded(F.col("order_number") / 4.0, 0))


@query(
    "f10_from_millis",
    """
    SELECT o_orderkey, strftime(o_orderdate + to_milliseconds(o_orderkey % 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS v
    FROM {orders}
    """,
)
def _(t):
    o = t["orders"]
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000
    return o.select("o_orderkey", S.from_millis(ms).alias("v"))


@query("f11_exists", "SELECT o_orderkey, o_orderkey % 3 <> 2 AS v FROM {orders}")
def _(t):
    return _expressions(t, v=S.exists(F.col("currency")))


@query(
    "f12_lookup",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 978 END AS v FROM {orders}""",
)
def _(t):
    return _expressions(t, v=S.lookup({"eur": 978, "gbp": 826}, F.coalesce("currency", F.lit("-"))))


@query("f13_count", f"SELECT o_orderkey, cast({ITEMS} as integer) AS n, 0 AS none FROM {{orders}}")
def _(t):
    return _expressions(t, n=S.count(F.col("items")), none=S.count(F.lit(None).cast("array<int>")))


_LIST = "(SELECT string_agg(concat({body}), ',' ORDER BY i) FROM range(o_orderkey % 4 + 1) r(i))"


@query(
    "f14_project_items",
    f"""
    SELECT o_orderkey, concat('[', {_LIST.format(body="'{\"material\":\"M-', cast((o_orderkey + i) % 2000 as varchar), '\",\"quantity\":', cast(i + 1 as varchar), '}'")}, ']') AS lines
    FROM {{orders}}
    """,
)
def _(t):
    return _expressions(t, lines=F.to_json(S.project(F.col("items"), {"material": "sku", "quantity": "qty"})))


@query(
    "f15_array_predicate",
    f"""SELECT o_orderkey, CASE WHEN {ITEMS} >= 2 THEN concat('M-', cast((o_orderkey + 1) % 2000 as varchar)) END AS sku FROM {{orders}}""",
)
def _(t):
    return _expressions(t, sku=S.at(S.where(F.col("items"), qty=2), 0)["sku"])


@query(
    "f16_index_first",
    f"""
    SELECT o_orderkey, concat('M-', cast(o_orderkey % 2000 as varchar)) AS head,
           concat('M-', cast((o_orderkey + {ITEMS} - 1) % 2000 as varchar)) AS tail,
           CASE o_orderkey % 3 WHEN 0 THEN 'eur' WHEN 1 THEN 'usd' ELSE o_orderstatus END AS present
    FROM {{orders}}
    """,
)
def _(t):
    items = F.col("items")
    return _expressions(
        t, head=S.at(items, 0)["sku"], tail=S.at(items, -1)["sku"], present=S.first_of(F.col("currency"), F.col("status"))
    )


@query(
    "f17_map_elements",
    f"""
    SELECT o_orderkey, {_LIST.format(body="lower(concat('M-', cast((o_orderkey + i) % 2000 as varchar))), 'x', cast((i + 1) * 10 as varchar)")} AS v
    FROM {{orders}}
    """,
)
def _(t):
    lines = S.each(F.col("items"), lambda x: S.join_text(S.lowercase(x["sku"]), "x", S.multiply(x["qty"], F.lit(10))))
    return _expressions(t, v=F.array_join(lines, ","))


@query(
    "f18_literals",
    """
    SELECT o_orderkey, concat('[{"price":', cast(o_custkey as varchar), ',"product":"service"}]') AS v FROM {orders}
    """,
)
def _(t):
    return _expressions(t, v=F.to_json(S.objects({"product": "service", "price": F.col("customer.id")})))
