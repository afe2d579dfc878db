"""Resolution, cross-reference and record-matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlink.functions.similarity import jaro_winkler
from flowlink.operators import linking as L
from flowlink.operators import matching as M
from flowlink.plans.registry import query

MATCH = [("email", "email"), ("email", "domain"), ("name", "name"), ("vat", "exact")]
THRESHOLD = 0.95


def refs(t):
    return t["order_refs"].select("id", "customer_ref", "amount")


def empty_map():
    return F.create_map().cast("map<string,string>")


def xref(t):
    return t["xref"].withColumn("attributes", empty_map())


@query(
    "j01_exact_resolve",
    "SELECT id, customer_ref, master_id AS customer_id FROM {order_refs} LEFT JOIN {xref} ON source_id = customer_ref AND entity = 'Customer' AND system = 'shop'",
)
def _(t):
    return L.resolve_exact(refs(t), t["xref"], "Customer", "shop", "customer_ref", "customer_id").select("id", "customer_ref", "customer_id")


@query(
    "j02_fallback_name",
    """
    SELECT id, coalesce(n.master_id, o.master_id) AS customer_id, n.master_id IS NULL AND o.master_id IS NOT NULL AS moved
    FROM {order_refs} LEFT JOIN {xref} n ON n.source_id = customer_ref AND n.system = 'shop'
    LEFT JOIN {xref} o ON o.source_id = customer_ref AND o.system = 'legacy'
    """,
)
def _(t):
    out = L.resolve_with_fallback(refs(t), t["xref"], "Customer", "shop", "legacy", "customer_ref", "customer_id")
    return out.select("id", "customer_id", "moved")


@query(
    "j02_move_links",
    """
    WITH r AS (SELECT DISTINCT customer_ref FROM {order_refs} WHERE id % 2 = 0)
    SELECT entity, CASE WHEN system = 'legacy' AND source_id IN (SELECT customer_ref FROM r)
                         AND source_id NOT IN (SELECT source_id FROM {xref} WHERE system = 'shop') THEN 'shop' ELSE system END AS system, source_id, master_id
    FROM {xref}
    """,
)
def _(t):
    read = t["order_refs"].filter("id % 2 = 0").select(F.col("customer_ref").alias("source_id"))
    return L.move_links(t["xref"], "Customer", "shop", "legacy", read)


@query(
    "j03_skip_unknown",
    """
    SELECT id, CASE WHEN master_id IS NULL THEN 'unknown customer_ref' END AS reason
    FROM {order_refs} LEFT JOIN {xref} ON source_id = customer_ref AND system = 'shop'
    """,
)
def _(t):
    resolved = L.resolve_exact(refs(t), t["xref"], "Customer", "shop", "customer_ref", "customer_id")
    known, skipped = L.skip_unknown(resolved, "customer_ref", "customer_id")
    return known.select("id", F.lit(None).cast("string").alias("reason")).unionByName(skipped.select("id", "reason"))


# --- Links ------------------------------------------------------------------------------


def proposed(t):
    usable = t["proposed"].filter("source_id <> '' AND trim(master_id) <> ''")
    return usable.select("source_id", F.trim("master_id").alias("master_id"), "seq", F.create_map(F.lit("email"), "email").alias("attributes"))


_LAST = """(SELECT source_id, max_by(trim(master_id), seq) AS master_id, max_by(email, seq) AS email FROM {proposed}
            WHERE source_id <> '' AND trim(master_id) <> '' GROUP BY source_id)"""
_STATUS = "CASE WHEN x.master_id IS NULL THEN 'added' WHEN x.master_id = p.master_id THEN 'unchanged' ELSE 'conflict' END"
_SHOP = "(SELECT * FROM {xref} WHERE system = 'shop')"


@query("w01_last_link_wins", f"SELECT source_id, master_id, email FROM {_LAST}")
def _(t):
    return L.last_links(proposed(t)).select("source_id", "master_id", F.col("attributes")["email"].alias("email"))


@query(
    "j08_compare_links",
    f"""
    SELECT p.source_id, p.master_id, {_STATUS} AS status, coalesce(x.master_id = p.master_id, true) AS writes
    FROM {_LAST} p LEFT JOIN {_SHOP} x ON x.source_id = p.source_id
    """,
)
def _(t):
    out = L.compare_links(L.last_links(proposed(t)), xref(t), "Customer", "shop")
    return out.select("source_id", "master_id", "status", "writes")


@query(
    "j10_write_links",
    """
    SELECT cast(o_orderkey as varchar) AS master_id, CASE WHEN o_orderkey % 5 <> 0 THEN concat('ERP-', cast(o_orderkey as varchar)) END AS source_id,
           CASE WHEN o_orderkey % 5 = 0 THEN 'the result has no id or the document no master' END AS error
    FROM {orders}
    """,
)
def _(t):
    key = F.col("o_orderkey")
    result = F.when(key % 5 != 0, F.concat(F.lit("ERP-"), key.cast("string")))
    return L.link_writes(t["orders"], "SalesOrder", "erp", result, key).select("master_id", "source_id", "error")


@query(
    "j10_unlink_undone",
    "SELECT source_id, master_id FROM {xref} WHERE system = 'shop' AND NOT (cast(source_id as bigint) % 6 = 0)",
)
def _(t):
    shop = t["xref"].filter("system = 'shop'")
    number = F.col("source_id").cast("bigint")
    # Every third link is named for undoing; odd ones lead to another master by now.
    undone = shop.filter(number % 3 == 0).withColumn("master_id", F.when(number % 2 == 0, F.col("master_id")).otherwise("C-elsewhere"))
    return L.delete_links(shop, undone).select("source_id", "master_id")


@query(
    "k02_upsert_links",
    f"""
    SELECT coalesce(p.source_id, x.source_id) AS source_id, coalesce(p.system, x.system) AS system, coalesce(p.master_id, x.master_id) AS master_id,
           CASE WHEN p.email LIKE '%@%' THEN p.email ELSE CASE WHEN x.source_id IS NOT NULL THEN 'old' END END AS email
    FROM (SELECT *, 'shop' AS system FROM {_LAST}) p FULL JOIN {{xref}} x ON x.source_id = p.source_id AND x.system = p.system
    """,
)
def _(t):
    known = t["xref"].withColumn("attributes", F.create_map(F.lit("email"), F.lit("old")))
    links = L.last_links(proposed(t)).select(
        F.lit("Customer").alias("entity"), F.lit("shop").alias("system"), "source_id", "master_id",
        F.when(F.col("attributes")["email"].contains("@"), F.col("attributes")).otherwise(empty_map()).alias("attributes"),
    )
    out = L.upsert_links(known, links)
    return out.select("source_id", "system", "master_id", F.col("attributes")["email"].alias("email"))


def planned(t):
    return L.plan_load(t["proposed"], xref(t), "Customer", "shop", "source_id", "master_id", [("email", "email")])


_PIECE = "cast(cast(concat('0x', substr(sha256(concat(p.source_id, chr(9), p.master_id)), 1, 15)) as bigint) as hugeint)"


@query(
    "a09_link_load_counts",
    f"""
    WITH c AS (SELECT p.source_id, p.master_id, p.email, {_STATUS} AS status, {_PIECE} AS piece FROM {_LAST} p LEFT JOIN {_SHOP} x ON x.source_id = p.source_id)
    SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'unchanged') AS unchanged, cast(0 as bigint) AS replaced,
           count(*) FILTER (status = 'conflict') AS conflict, count(*) FILTER (status = 'added' OR (status = 'unchanged' AND email LIKE '%@%')) AS written,
           cast(sum(piece) FILTER (status <> 'conflict') as varchar) AS digest, (SELECT count(*) FROM {{proposed}}) AS read,
           (SELECT count(*) FROM {{proposed}} WHERE source_id = '') AS without_source,
           (SELECT count(*) FROM {{proposed}} WHERE source_id <> '' AND trim(master_id) = '') AS without_master
    FROM c
    """,
)
def _(t):
    return L.load_counts(planned(t))


@query(
    "k15_link_load",
    f"""
    SELECT coalesce(p.source_id, x.source_id) AS source_id, CASE WHEN x.master_id IS NULL THEN p.master_id ELSE x.master_id END AS master_id,
           CASE WHEN p.email LIKE '%@%' AND (x.master_id IS NULL OR x.master_id = p.master_id) THEN p.email END AS email
    FROM {_LAST} p FULL JOIN {_SHOP} x ON x.source_id = p.source_id
    """,
)
def _(t):
    return planned(t).merged.select("source_id", "master_id", F.col("attributes")["email"].alias("email"))


@query(
    "k15_link_load_changes",
    f"""
    SELECT p.source_id, p.master_id, CASE WHEN p.email LIKE '%@%' THEN p.email END AS email FROM {_LAST} p LEFT JOIN {_SHOP} x ON x.source_id = p.source_id
    WHERE x.master_id IS NULL OR (x.master_id = p.master_id AND p.email LIKE '%@%')
    """,
)
def _(t):
    changes = L.load_changes(planned(t).merged)
    return changes.select("source_id", "master_id", F.col("attributes")["email"].alias("email"))


@query(
    "k15_link_load_conflicts",
    f"""
    SELECT p.source_id, x.master_id AS linked, p.master_id AS proposed FROM {_LAST} p JOIN {_SHOP} x ON x.source_id = p.source_id
    WHERE x.master_id <> p.master_id
    """,
)
def _(t):
    return L.load_conflicts(planned(t).merged)


# --- Matching ---------------------------------------------------------------------------


def attributed(t):
    # They come as one small file, which a single task would read.
    return M.extract_attributes(t["people"].repartition("id"), MATCH)


def new_records(t):
    """People without a link: each fourth."""
    return attributed(t).filter("id % 4 = 3").select(F.lit("Customer").alias("entity"), F.col("source_id").alias("record_id"), *M.ATTRIBUTES)


def linked_records(t):
    return attributed(t).filter("id % 4 <> 3").select(F.lit("Customer").alias("entity"), "source_id", "master_id", *M.ATTRIBUTES)


FREE = ", ".join(f"'{d}'" for d in M.FREE_MAIL)
ATTRS = (
    """
    attrs AS (SELECT id, source_id, master_id, email, CASE WHEN domain NOT IN (FREE_MAIL) THEN domain END AS domain, name, vat FROM (
      SELECT id, source_id, master_id, CASE WHEN strpos(e, '@') > 1 THEN e END AS email, CASE WHEN strpos(e, '@') > 1 THEN split_part(e, '@', 2) END AS domain,
             trim(regexp_replace(lower(name), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS name, upper(regexp_replace(vat, '\\s+', '', 'g')) AS vat
      FROM (SELECT *, lower(trim(email)) AS e FROM {people})))
    """
).replace("FREE_MAIL", FREE)
SIDES = ATTRS + ", a AS (SELECT * FROM attrs WHERE id % 4 = 3), b AS (SELECT * FROM attrs WHERE id % 4 <> 3)"
PAIRS = SIDES + """,
    pairs AS (SELECT a.id AS i, b.id AS j FROM a JOIN b ON a.email = b.email UNION SELECT a.id, b.id FROM a JOIN b ON a.domain = b.domain
      UNION SELECT a.id, b.id FROM a JOIN b ON left(a.name, 3) = left(b.name, 3) UNION SELECT a.id, b.id FROM a JOIN b ON a.vat = b.vat)
"""
LEVELS = PAIRS + """,
    levels AS (SELECT a.source_id AS record_id, b.source_id, b.master_id,
      CASE WHEN a.email = b.email THEN 'email.same' WHEN a.email <> b.email THEN 'email.differs' END AS email,
      CASE WHEN a.email = b.email THEN NULL WHEN a.domain = b.domain THEN 'domain.same' WHEN a.domain <> b.domain THEN 'domain.differs' END AS domain,
      CASE WHEN a.name = b.name THEN 'name.same' WHEN a.name <> b.name THEN 'name.differs' END AS name,
      CASE WHEN a.vat = b.vat THEN 'exact.same' WHEN a.vat <> b.vat THEN 'exact.differs' END AS exact
      FROM pairs JOIN a ON a.id = i JOIN b ON b.id = j)
"""


def _weight(kind: str, model: M.Model = M.DEFAULT_MODEL) -> str:
    cases = " ".join(
        f"WHEN '{n}' THEN ln({model.levels[n][0]!r} / {model.levels[n][1]!r})" for n in M.DEFAULT_LEVELS if n.startswith(kind)
    )
    return f"coalesce(CASE {kind} {cases} END, 0)"


SCORES = LEVELS + f""",
    odds AS (SELECT *, 0.05 / 0.95 * exp({_weight('email')} + {_weight('domain')} + {_weight('name')} + {_weight('exact')}) AS o,
      concat_ws(', ', CASE WHEN email = 'email.same' THEN 'same email address' END, CASE WHEN domain = 'domain.same' THEN 'same company email domain' END,
        CASE WHEN name = 'name.same' THEN 'same name' END, CASE WHEN exact = 'exact.same' THEN 'same vat' END) AS reasons FROM levels),
    scores AS (SELECT record_id, source_id, master_id, o / (1 + o) AS score, reasons FROM odds)
"""
TOP = SCORES + """,
    best AS (SELECT *, row_number() OVER (PARTITION BY record_id, master_id ORDER BY score DESC, source_id) AS n FROM scores WHERE reasons <> ''),
    top AS (SELECT record_id, master_id, round(score, 3) AS score, reasons, row_number() OVER (PARTITION BY record_id ORDER BY round(score, 3) DESC, master_id) AS rank
            FROM best WHERE n = 1)
"""
CERTAIN = TOP + f""",
    certain AS (SELECT f.* FROM top f LEFT JOIN top s ON s.record_id = f.record_id AND s.rank = 2
                WHERE f.rank = 1 AND f.score >= {THRESHOLD} AND coalesce(s.score, 0) < 0.5)
"""


@query("i01_extract_attributes", f"WITH {ATTRS} SELECT id, email, domain, name, vat FROM attrs")
def _(t):
    return attributed(t).select("id", "email", "domain", "name", F.get("exact", 0)["value"].alias("vat"))


@query("j04_candidate_pairs", f"WITH {PAIRS} SELECT a.source_id AS record_id, b.source_id FROM pairs JOIN a ON a.id = i JOIN b ON b.id = j")
def _(t):
    return M.candidate_pairs(new_records(t), linked_records(t)).select("record_id", "source_id")


@query(
    "j04_block_sizes",
    f"""
    WITH {SIDES}, p AS (SELECT DISTINCT email, domain, name, vat FROM b)
    SELECT 'email' AS rule, email AS key, count(*) AS size FROM p WHERE email IS NOT NULL GROUP BY email
    UNION ALL SELECT 'domain', domain, count(*) FROM p WHERE domain IS NOT NULL GROUP BY domain
    UNION ALL SELECT 'name', left(name, 3), count(*) FROM p WHERE name IS NOT NULL GROUP BY left(name, 3)
    UNION ALL SELECT 'exact:vat', vat, count(*) FROM p WHERE vat IS NOT NULL GROUP BY vat
    """,
)
def _(t):
    return M.block_sizes(linked_records(t)).select("rule", "key", "size")


def pairs(t):
    """Candidate pairs with both sides' attributes."""
    return M.candidate_pairs(new_records(t), linked_records(t), attributes=True)


@query("i02_compare_levels", f"WITH {LEVELS} SELECT record_id, source_id, email, domain, name, exact FROM levels")
def _(t):
    found = pairs(t)
    levels = M.compare(similarity=M.pair_similarity(found))
    return found.select(
        "record_id", "source_id", levels["email"].alias("email"), levels["domain"].alias("domain"), levels["name"].alias("name"),
        F.get(levels["exact"], 0)["level"].alias("exact"),
    )


@query("i03_score_pairs", f"WITH {SCORES} SELECT record_id, source_id, round(score, 3) AS score, reasons FROM scores")
def _(t):
    out = M.score_pairs(pairs(t), decimals=3)
    return out.select("record_id", "source_id", "score", F.array_join("reasons", ", ").alias("reasons"))


@query(
    "i04_jaro_winkler",
    """
    WITH n AS (SELECT DISTINCT p_name AS name FROM {part}),
    p AS (SELECT a.name, b.name AS other, jaro_similarity(a.name, b.name) AS j,
            CASE WHEN left(a.name, 4) = left(b.name, 4) AND length(a.name) >= 4 AND length(b.name) >= 4 THEN 4 WHEN left(a.name, 3) = left(b.name, 3) AND length(a.name) >= 3 AND length(b.name) >= 3 THEN 3
                 WHEN left(a.name, 2) = left(b.name, 2) AND length(a.name) >= 2 AND length(b.name) >= 2 THEN 2 ELSE 1 END AS same
          FROM n a JOIN n b ON left(a.name, 1) = left(b.name, 1) AND a.name < b.name)
    SELECT name, other, round(j + same * 0.1 * (1 - j), 6) AS similarity FROM p
    """,
)
def _(t):
    names = t["part"].select(F.col("p_name").alias("name"), F.substring("p_name", 1, 1).alias("letter")).distinct()
    other = names.select(F.col("name").alias("other"), "letter")
    near = names.join(other, "letter").filter(F.col("name") < F.col("other"))
    return near.select("name", "other", F.round(jaro_winkler("name", "other"), 6).alias("similarity"))


@query("i05_suggest", f"WITH {TOP} SELECT record_id, master_id, score, reasons, cast(rank as integer) AS rank FROM top WHERE rank <= 3")
def _(t):
    out = M.suggest(new_records(t), linked_records(t))
    return out.select("record_id", "master_id", "score", F.array_join("reasons", ", ").alias("reasons"), "rank")


@query("i05_suggest_hot_blocks", f"WITH {TOP} SELECT record_id, master_id, score, reasons, cast(rank as integer) AS rank FROM top WHERE rank <= 3")
def _(t):
    # Blocks of more than five linked records (the domains) count as hot: the grouped search must agree.
    out = M.suggest(new_records(t), linked_records(t), hot_block=5, chunk=64)
    return out.select("record_id", "master_id", "score", F.array_join("reasons", ", ").alias("reasons"), "rank")


@query("i06_decide", f"WITH {CERTAIN} SELECT record_id, master_id, score, reasons FROM certain")
def _(t):
    out = M.decide(M.suggest(new_records(t), linked_records(t)), THRESHOLD)
    return out.select("record_id", "master_id", "score", F.array_join("reasons", ", ").alias("reasons"))


@query("w02_top_and_runner_up", f"WITH {TOP} SELECT f.record_id, f.master_id AS best, s.master_id AS runner_up, f.score - coalesce(s.score, 0) AS lead FROM top f LEFT JOIN top s ON s.record_id = f.record_id AND s.rank = 2 WHERE f.rank = 1")
def _(t):
    top = M.suggest(new_records(t), linked_records(t), limit=2)
    by_rank = top.groupBy("record_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("master_id"))).alias("best"),
        F.max(F.when(F.col("rank") == 2, F.col("master_id"))).alias("runner_up"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
    )
    return by_rank.select("record_id", "best", "runner_up", (F.col("s1") - F.coalesce("s2", F.lit(0.0))).alias("lead"))


def resolution(t):
    """Orders resolved by their customer, a quarter of whom have no link yet."""
    people = t["people"].select(F.col("source_id").alias("customer_ref"), "email", "name", "vat")
    docs = t["order_refs"].select("id", "customer_ref").join(people, "customer_ref", "left")
    links = linked_records(t).select(
        "entity", F.lit("shop").alias("system"), "source_id", "master_id", M.attributes_map().alias("attributes")
    )
    return L.resolve(docs, links, "Customer", "shop", "customer_ref", "customer_id", MATCH, THRESHOLD)


@query(
    "i07_resolve_documents",
    f"""
    WITH {CERTAIN} SELECT o.id, o.customer_ref, coalesce(b.master_id, c.master_id) AS customer_id
    FROM {{order_refs}} o LEFT JOIN b ON b.source_id = o.customer_ref LEFT JOIN certain c ON c.record_id = o.customer_ref
    """,
)
def _(t):
    return resolution(t).resolved.select("id", "customer_ref", "customer_id")


@query(
    "i07_new_links",
    f"""
    WITH {CERTAIN} SELECT record_id AS source_id, master_id, score, reasons FROM certain
    WHERE record_id IN (SELECT customer_ref FROM {{order_refs}})
    """,
)
def _(t):
    return resolution(t).links.select("source_id", "master_id", "score", F.array_join("reasons", ", ").alias("reasons"))


@query(
    "i07_steward_queue",
    f"""
    WITH {CERTAIN}, refs AS (SELECT DISTINCT customer_ref FROM {{order_refs}})
    SELECT customer_ref AS ref, (SELECT coalesce(string_agg(master_id, ',' ORDER BY rank), '') FROM top WHERE record_id = customer_ref AND rank <= 3) AS suggested
    FROM refs WHERE customer_ref NOT IN (SELECT source_id FROM b) AND customer_ref NOT IN (SELECT record_id FROM certain)
    """,
)
def _(t):
    waiting = resolution(t).unresolved
    names = F.transform(F.coalesce("suggestions", F.array()), lambda s: s["master_id"])
    return waiting.select("ref", F.array_join(names, ",").alias("suggested"))
