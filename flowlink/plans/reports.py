"""Audit, run, write, approval and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlink.operators import audit as A
from flowlink.operators import reports as R
from flowlink.plans.registry import derive, query
from flowlink.session import scratch
from flowlink.streaming import intake as S

CHAIN = 50
NOW = 1706745600000


def audit_lines(t):
    """Audit chains of fifty entries, sealed entry by entry; some entries are then altered.

    A chain's entries follow from one another, so each chain is sealed inside one row.
    """
    e = t["events"].select(
        F.floor(F.col("event_id") / CHAIN).alias("chain"), (F.col("event_id") % CHAIN + 1).alias("row_seq"), "event_id",
        F.format_string(
            '"time":"%s","actor":"u%d","action":"%s","data":{"target":"t%d","operation":"%s","error":"E%d"}',
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "user_id",
            F.when(F.col("event_type") == "error", "writeback.failed").otherwise(F.concat(F.lit("writeback."), "event_type")),
            F.col("user_id") % 7, "event_type", "event_id",
        ).alias("body"),
    )
    chains = e.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("row_seq", "event_id", "body"))).alias("entries"))

    def link(done, x):
        prev = F.coalesce(F.try_element_at(done, F.lit(-1))["hash"], F.lit(A.GENESIS))
        text = F.concat(F.format_string('{"seq":%d,', x["row_seq"]), x["body"], F.lit(',"prev":"'), prev, F.lit('","hash":"'))
        sealed = F.sha2(F.concat(text, F.lit('"}')), 256)
        return F.concat(
            done,
            F.array(F.struct(x["row_seq"].alias("row_seq"), x["event_id"].alias("event_id"), sealed.alias("hash"), F.concat(text, sealed, F.lit('"}')).alias("line"))),
        )

    empty = F.array().cast("array<struct<row_seq:bigint,event_id:bigint,hash:string,line:string>>")
    rows = chains.select("chain", F.inline(F.aggregate("entries", empty, link)))
    altered = F.when(F.col("event_id") % 173 == 0, F.regexp_replace("line", '"actor":"u', '"actor":"x')).when(
        F.col("event_id") % 307 == 5, F.regexp_replace("line", '"prev":"[0-9a-f]', '"prev":"g')
    ).otherwise(F.col("line"))
    return rows.filter("event_id % 211 <> 1").select("chain", "row_seq", altered.alias("line"))


_ENTRIES = f"(SELECT event_id // {CHAIN} AS chain, event_id % {CHAIN} + 1 AS row_seq, event_id FROM {{events}} WHERE event_id % 211 <> 1)"
_BROKEN = f"""(SELECT chain, row_seq, CASE WHEN (event_id - 1) % 211 = 1 AND row_seq > 1 THEN 'gap before' WHEN event_id % 307 = 5 AND event_id % 173 <> 0 THEN 'does not link'
               WHEN event_id % 173 = 0 THEN 'content does not match' END AS problem FROM {_ENTRIES})"""


@query("k16_audit_verify", f"SELECT e.chain, max(row_seq) AS last_seq, count(*) AS entries, min(row_seq) FILTER (problem IS NOT NULL) AS broken_at, min_by(problem, row_seq) FILTER (problem IS NOT NULL) AS problem FROM {_BROKEN} e GROUP BY e.chain")
def _(t):
    return A.verify(audit_lines(t), ["chain"])


@query("k16_broken_entries", f"SELECT * FROM {_BROKEN} WHERE problem IS NOT NULL")
def _(t):
    return A.broken_entries(audit_lines(t), ["chain"])


def entries(t):
    """One flat log of the same entries, numbered by event."""
    lines = audit_lines(t).withColumn("entry", F.col("chain") * CHAIN + F.col("row_seq"))
    return A.parse(lines).withColumn("seq", F.col("entry"))


@query(
    "l01_audit_tail",
    f"SELECT event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'writeback.failed' ELSE concat('writeback.', event_type) END AS action FROM {{events}} WHERE event_id % 211 <> 1 ORDER BY event_id DESC LIMIT 100",
)
def _(t):
    return A.tail(entries(t), 100).select("seq", "action")


@query(
    "k17_refused_writes",
    """
    SELECT event_id + 1 AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, event_type AS operation, concat('E', cast(event_id as varchar)) AS error
    FROM {events} WHERE event_type = 'error' AND user_id % 7 = 3 AND event_id % 211 <> 1 AND strftime(ts, '%Y-%m-%dT%H:%M:%SZ') > '2024-01-15T00:00:00Z'
    """,
)
def _(t):
    return A.refusals(entries(t), "t3", F.lit("2024-01-15T00:00:00Z"))


# --- Runs -------------------------------------------------------------------------------


@query(
    "a01_runs_by_outcome",
    """
    SELECT workflow, status AS outcome, CASE WHEN status = 'failed' THEN coalesce(failure_type, 'error') ELSE '' END AS reason, count(*) AS runs
    FROM {runs} WHERE status <> 'running' GROUP BY 1, 2, 3
    """,
)
def _(t):
    return R.runs_by_outcome(t["runs"])


_ACTIVE = "(SELECT *, closed_ms - started_ms - waited_ms AS active_ms FROM {runs} WHERE status = 'completed')"


@query(
    "a02_run_latency",
    f"""
    WITH r AS (SELECT workflow, active_ms, row_number() OVER (PARTITION BY workflow ORDER BY active_ms) - 1 AS i, count(*) OVER (PARTITION BY workflow) AS n FROM {_ACTIVE}),
    s AS (SELECT unnest([0.5, 0.95, 0.99]) AS share)
    SELECT workflow, cast(share as double) AS share, active_ms FROM r JOIN s ON i = cast(floor(share * (n - 1)) as bigint)
    """,
)
def _(t):
    return R.run_latency(t["runs"])


derive(
    "approval_requests",
    """
    SELECT o_orderpriority AS workflow, o_orderkey AS run_id, 1 AS step, md5(concat(cast(o_orderkey as string), 'x')) AS digest, epoch_ms(o_orderdate) AS asked_ms
    FROM {orders}
    """,
)
derive(
    "approval_signals",
    """
    SELECT l_orderkey AS run_id, l_linenumber % 2 + 1 AS step, md5(concat(cast(l_orderkey as string), CASE WHEN l_linenumber % 3 = 0 THEN 'y' ELSE 'x' END)) AS digest,
           CASE WHEN l_returnflag = 'A' THEN 'approved' ELSE 'no' END AS status, concat('p', cast(l_suppkey as string)) AS actor, epoch_ms(l_shipdate) + l_partkey AS at_ms
    FROM {lineitem}
    """,
)
TIMEOUT = 600 * 86_400_000
CLOCK = 920_000_000_000  # 1999-02-26
_DECIDED = f"""
    (SELECT r.workflow, r.run_id, CASE WHEN s IS NULL THEN CASE WHEN {CLOCK} >= asked_ms + {TIMEOUT} THEN 'rejected' ELSE 'pending' END WHEN s.status = 'approved' THEN 'approved' ELSE 'rejected' END AS status,
       CASE WHEN s IS NOT NULL THEN s.actor WHEN {CLOCK} >= asked_ms + {TIMEOUT} THEN '{R.TIMEOUT_ACTOR}' END AS decided_by,
       CASE WHEN s IS NOT NULL THEN s.at_ms - asked_ms WHEN {CLOCK} >= asked_ms + {TIMEOUT} THEN {TIMEOUT} END AS wait_ms
     FROM {{approval_requests}} r LEFT JOIN (
       SELECT q.run_id, min({{'at_ms': g.at_ms, 'status': g.status, 'actor': g.actor}}) AS s FROM {{approval_requests}} q JOIN {{approval_signals}} g ON g.run_id = q.run_id AND g.step = q.step AND g.digest = q.digest
       WHERE g.at_ms >= q.asked_ms AND g.at_ms < q.asked_ms + {TIMEOUT} AND g.at_ms <= {CLOCK} GROUP BY q.run_id) f ON f.run_id = r.run_id)
"""


def decisions(t):
    return R.decide_approvals(t["approval_requests"], t["approval_signals"], TIMEOUT, CLOCK)


@query("t05_approval_decisions", f"SELECT run_id, status, decided_by, wait_ms FROM {_DECIDED}")
def _(t):
    return decisions(t).select("run_id", "status", "decided_by", "wait_ms")


@query(
    "a03_approvals_by_decision",
    f"""SELECT workflow, CASE WHEN decided_by = '{R.TIMEOUT_ACTOR}' THEN 'timed_out' ELSE status END AS decision, count(*) AS approvals, cast(sum(wait_ms) as bigint) AS wait_ms, max(wait_ms) AS longest_ms
        FROM {_DECIDED} GROUP BY 1, 2""",
)
def _(t):
    return R.approvals_by_decision(decisions(t))


@query("a04_writes_by_status", "SELECT target, operation, status, count(*) AS writes FROM {writes_log} GROUP BY 1, 2, 3")
def _(t):
    return R.writes_by_status(t["writes_log"])


_BOUNDS = ", ".join(f"({float(b)})" for b in R.DURATION_BUCKETS)


@query(
    "a04_write_durations",
    f"""
    SELECT target, cast(b as double) AS le, count(*) FILTER (duration <= coalesce(b, 1e18)) AS "count" FROM {{writes_log}}, (VALUES {_BOUNDS}, (NULL)) v(b) GROUP BY target, b
    """,
)
def _(t):
    return R.duration_histogram(t["writes_log"], ["target"])


@query("a05_events_by_arrival", "SELECT source AS workflow, CASE via WHEN 'webhook' THEN 'inbox' ELSE via END AS via, count(*) AS events FROM {arrivals} GROUP BY 1, 2")
def _(t):
    via = F.when(F.col("via") == "webhook", "inbox").otherwise(F.col("via"))
    return R.events_by_arrival(t["arrivals"].select(F.col("source").alias("workflow"), via.alias("via")))


@query("a06_metered_documents", "SELECT target, count(*) AS documents FROM {writes_log} WHERE metered AND status = 'committed' GROUP BY target")
def _(t):
    return R.metered_documents(t["writes_log"])


derive(
    "attempts",
    """
    SELECT run_id, 1 AS attempt, status, failure_type, 'Customer' AS entity, workflow AS system, cast(user_id as string) AS ref, closed_ms, concat('S', cast(run_id as string)) AS suggestions FROM {runs}
    UNION ALL SELECT run_id, 2, CASE WHEN run_id % 2 = 0 THEN 'completed' ELSE status END, failure_type, 'Customer', workflow, cast(user_id as string), closed_ms + 5000, concat('T', cast(run_id as string))
    FROM {runs} WHERE run_id % 4 < 2
    """,
)
_NEWEST = "(SELECT * FROM {attempts} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY attempt DESC) = 1)"


@query("w03_newest_attempt", f"SELECT run_id, attempt, status FROM {_NEWEST}")
def _(t):
    return R.newest_attempts(t["attempts"]).select("run_id", "attempt", "status")


@query(
    "a07_steward_queue",
    f"""
    SELECT entity, system, ref, count(*) AS runs, min(closed_ms) AS since, max_by(suggestions, {{'c': closed_ms, 'r': run_id}}) AS suggestions, max_by(run_id, {{'c': closed_ms, 'r': run_id}}) AS newest_run
    FROM {_NEWEST} WHERE status = 'failed' AND failure_type = 'Unresolved' GROUP BY entity, system, ref
    """,
)
def _(t):
    return R.steward_queue(t["attempts"])


@query(
    "l02_newest_runs",
    "SELECT run_id, status, CASE WHEN status = 'running' THEN 'pending' WHEN skipped THEN 'skipped' END AS note FROM {runs} ORDER BY started_ms DESC, run_id DESC LIMIT 250",
)
def _(t):
    return R.newest_runs(t["runs"], 250).select("run_id", "status", "note")


@query(
    "a11_skipped_runs",
    """
    SELECT CASE WHEN skipped THEN coalesce(failure_type, 'unknown reference') ELSE 'not skipped' END AS reason, count(*) AS runs
    FROM (SELECT * FROM {runs} ORDER BY started_ms DESC, run_id DESC LIMIT 2000) GROUP BY 1
    """,
)
def _(t):
    return R.skipped_report(t["runs"], 2000)


derive(
    "slots",
    """
    SELECT s_suppkey AS slot, printf('%X/%X', s_suppkey + 1, s_suppkey * 1000003 % 4294967296) AS current_lsn, printf('%X/%X', s_suppkey, s_suppkey * 77 % 4294967296) AS restart_lsn
    FROM {supplier}
    """,
)


@query("a13_retained_log", "SELECT s_suppkey AS slot, 4294967296 + s_suppkey * 1000003 % 4294967296 - s_suppkey * 77 % 4294967296 AS retained_bytes FROM {supplier}")
def _(t):
    return R.retained_log(t["slots"]).select("slot", "retained_bytes")


@query(
    "w08_breaker_openings",
    """
    WITH s AS (SELECT *, sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY seq) AS streak FROM {writes_log}),
    f AS (SELECT *, row_number() OVER (PARTITION BY target, streak ORDER BY seq) AS place FROM s WHERE status = 'failed')
    SELECT target, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS failures, max(at_ms) FILTER (place = 5) AS opened_ms, max(at_ms) FILTER (place = 5) + 30000 AS trial_ms
    FROM f GROUP BY target, streak HAVING count(*) >= 5
    """,
)
def _(t):
    return R.breaker_openings(t["writes_log"])


# --- Alerts -----------------------------------------------------------------------------


@query(
    "t07_failing_runs",
    """
    WITH s AS (SELECT workflow, closed_ms // 300000 * 300000 AS slot, status FROM {runs} WHERE status <> 'running'),
    w AS (SELECT workflow, slot + 300000 * i AS window_end_ms, status FROM s, range(1, 13) r(i))
    SELECT workflow, window_end_ms, count(*) AS finished, count(*) FILTER (status = 'failed') AS failed FROM w GROUP BY 1, 2
    HAVING count(*) FILTER (status = 'failed') >= 3 AND count(*) FILTER (status = 'failed') / count(*) > 0.6
    """,
)
def _(t):
    return R.failing_runs(t["runs"], 0.6).select("workflow", "window_end_ms", F.col("finished").cast("bigint").alias("finished"), "failed")


_FAILING = """
    WITH s AS (SELECT workflow, closed_ms // 300000 * 300000 AS slot, status FROM {runs} WHERE status <> 'running'),
    w AS (SELECT workflow, slot + 300000 * i AS window_end_ms, status FROM s, range(1, 13) r(i)),
    f AS (SELECT workflow, window_end_ms, count(*) AS finished, count(*) FILTER (status = 'failed') AS failed FROM w GROUP BY 1, 2)
"""


@query(
    "t07_failing_runs_lasting",
    _FAILING + """, g AS (SELECT *, window_end_ms - 300000 * row_number() OVER (PARTITION BY workflow ORDER BY window_end_ms) AS spell FROM f WHERE failed >= 3 AND failed / finished > 0.6)
    SELECT workflow, min(window_end_ms) AS since_ms, min(window_end_ms) + 600000 AS fires_ms, max(window_end_ms) AS last_ms FROM g GROUP BY workflow, spell HAVING max(window_end_ms) - min(window_end_ms) >= 600000
    """,
)
def _(t):
    return R.lasting(R.failing_runs(t["runs"], 0.6), ["workflow"], 10 * R.MINUTE)


@query(
    "t07_failing_runs_stream",
    _FAILING + "SELECT workflow, window_end_ms, finished, failed FROM f WHERE failed >= 3 AND failed / finished > 0.6 AND window_end_ms <= (SELECT max(closed_ms) FROM {runs} WHERE status <> 'running') - 60000",
)
def _(t):
    done = t["runs"].filter(F.col("status").isin("completed", "failed")).select("workflow", "status", F.timestamp_millis("closed_ms").alias("at"))
    path, out = scratch(t.spark, "runs"), scratch(t.spark, "windows")
    done.orderBy("at").coalesce(1).write.parquet(path)
    stream = S.read_folder(t.spark, path, done.schema)
    counts = {"finished": F.lit(True), "failed": F.col("status") == "failed"}
    windows = R.stream_windows(stream, ["workflow"], counts, "at", "1 minute", "1 hour", "5 minutes")
    S.to_table(windows, out, scratch(t.spark, "checkpoint"))
    return t.spark.read.parquet(out).filter((F.col("failed") >= 3) & (F.col("failed") / F.col("finished") > 0.6))


@query(
    "t07_steward_waits_sliding",
    """
    WITH s AS (SELECT workflow, closed_ms // 300000 * 300000 AS slot FROM {runs} WHERE failure_type = 'Unresolved')
    SELECT workflow, slot + 300000 * i AS window_end_ms, count(*) AS events FROM s, range(1, 13) r(i) GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def _(t):
    timed = t["runs"].withColumn("at_ms", F.col("closed_ms"))
    return R.alert_windows(timed, ["workflow"], F.col("failure_type") == "Unresolved", 60 * R.MINUTE, above=1).select("workflow", "window_end_ms", "events")


@query(
    "t07_slow_runs_sliding",
    f"""
    WITH r AS (SELECT workflow, closed_ms // 300000 * 300000 + 300000 * i AS window_end_ms, active_ms FROM {_ACTIVE}, range(1, 7) x(i)),
    n AS (SELECT *, row_number() OVER (PARTITION BY workflow, window_end_ms ORDER BY active_ms) - 1 AS i, count(*) OVER (PARTITION BY workflow, window_end_ms) AS c FROM r)
    SELECT workflow, window_end_ms, active_ms, length(workflow) * 12000 AS target_ms FROM n WHERE i = cast(floor(0.95 * (c - 1)) as bigint) AND active_ms > length(workflow) * 12000
    """,
)
def _(t):
    targets = t["runs"].select("workflow").distinct().withColumn("target_ms", (F.length("workflow") * 12000).cast("bigint"))
    return R.slow_windows(t["runs"], targets).select("workflow", "window_end_ms", "active_ms", "target_ms")


@query(
    "t07_steward_waits",
    "SELECT workflow, closed_ms // 3600000 * 3600000 AS window_ms, count(*) AS events FROM {runs} WHERE failure_type = 'Unresolved' GROUP BY 1, 2",
)
def _(t):
    return R.counted_alert(t["runs"].withColumn("at_ms", F.col("closed_ms")), ["workflow"], F.col("failure_type") == "Unresolved", 60 * R.MINUTE)


@query(
    "t07_failed_compensations",
    """SELECT workflow, closed_ms // 900000 * 900000 AS window_ms, count(*) AS events FROM {runs}
       WHERE status = 'failed' AND run_id % 4 = 1 GROUP BY 1, 2""",
)
def _(t):
    kind = F.when((F.col("status") == "failed") & (F.col("run_id") % 4 == 1), "CompensationFailed").otherwise(F.col("failure_type"))
    return R.failed_compensations(t["runs"].withColumn("failure_type", kind))


@query(
    "t07_retained_logs",
    """
    WITH s AS (SELECT user_id AS slot, epoch_ms(ts) AS at_ms, event_id, value > 100 AS over FROM {events}),
    d AS (SELECT slot, at_ms, bool_and(over) AS over, count(*) AS n FROM s GROUP BY slot, at_ms),
    g AS (SELECT *, count(*) FILTER (NOT over) OVER (PARTITION BY slot ORDER BY at_ms) AS spell FROM d)
    SELECT slot, min(at_ms) AS since_ms, max(at_ms) AS last_ms, cast(sum(n) as bigint) AS samples FROM g WHERE over GROUP BY slot, spell HAVING max(at_ms) - min(at_ms) > 86400000
    """,
)
def _(t):
    e = t["events"].select(F.col("user_id").alias("slot"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "value")
    # One reading per slot and time: the lowest, so that a spell is over when any reading is.
    readings = e.groupBy("slot", "at_ms").agg(F.min("value").alias("retained_bytes"), F.count(F.lit(1)).alias("n"))
    spells = R.retained_logs(readings.select("slot", "at_ms", "retained_bytes"), 100, 24 * 60 * R.MINUTE)
    counted = readings.alias("r").join(spells.alias("s"), (F.col("r.slot") == F.col("s.slot")) & F.col("r.at_ms").between(F.col("since_ms"), F.col("last_ms")))
    return counted.groupBy(F.col("s.slot").alias("slot"), "since_ms", "last_ms").agg(F.sum("n").alias("samples"))


@query(
    "t07_slow_runs",
    f"""
    WITH r AS (SELECT workflow, closed_ms // 1800000 * 1800000 AS window_ms, active_ms FROM {_ACTIVE}),
    n AS (SELECT *, row_number() OVER (PARTITION BY workflow, window_ms ORDER BY active_ms) - 1 AS i, count(*) OVER (PARTITION BY workflow, window_ms) AS c FROM r)
    SELECT workflow, window_ms, active_ms, length(workflow) * 12000 AS target_ms FROM n WHERE i = cast(floor(0.95 * (c - 1)) as bigint) AND active_ms > length(workflow) * 12000
    """,
)
def _(t):
    targets = t["runs"].select("workflow").distinct().withColumn("target_ms", (F.length("workflow") * 12000).cast("bigint"))
    return R.slow_runs(t["runs"], targets)


@query(
    "t07_stalled_polls",
    f"SELECT concat('u', cast(user_id as varchar)) AS workflow, max(epoch_ms(ts)) AS last_ms FROM {{events}} GROUP BY user_id HAVING {NOW} - max(epoch_ms(ts)) > 2 * 86400000",
)
def _(t):
    polls = t["events"].select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("workflow"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return R.stalled_polls(polls, NOW, 2 * 86_400_000)


@query(
    "t07_webhook_rejections",
    "SELECT user_id % 10 AS endpoint, epoch_ms(ts) // 900000 * 900000 AS window_ms, count(*) AS events FROM {events} WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    e = t["events"].select((F.col("user_id") % 10).alias("endpoint"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return R.counted_alert(e, ["endpoint"], F.col("event_type") == "error", 15 * R.MINUTE, above=1)


@query(
    "t07_approval_timeouts",
    f"""SELECT workflow, (asked_ms + {TIMEOUT}) // 86400000 * 86400000 AS window_ms, count(*) AS events FROM {_DECIDED} d JOIN (SELECT run_id AS r, asked_ms FROM {{approval_requests}}) q ON r = run_id
        WHERE decided_by = '{R.TIMEOUT_ACTOR}' GROUP BY 1, 2""",
)
def _(t):
    timed = decisions(t).withColumn("at_ms", F.col("asked_ms") + F.col("wait_ms"))
    return R.counted_alert(timed, ["workflow"], F.col("decided_by") == R.TIMEOUT_ACTOR, 24 * 60 * R.MINUTE)
