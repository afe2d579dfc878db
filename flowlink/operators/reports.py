"""Reports over runs, writes, events and approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlink.functions.prefix import run_starts
from flowlink.operators.inbox import first_by

# Upper bounds of the duration histogram, in seconds.
DURATION_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120, 300)
BREAKER_FAILURES = 5
BREAKER_COOLDOWN_MS = 30_000
TIMEOUT_ACTOR = "flowlink/approval-timeout"
MINUTE = 60_000


# --- Counts -----------------------------------------------------------------------------


def runs_by_outcome(runs: DataFrame) -> DataFrame:
    """Finished runs by workflow, outcome and reason (the failure's type, or error)."""
    failed = F.col("status") == "failed"
    done = runs.filter(F.col("status").isin("completed", "failed"))
    reason = F.when(failed, F.coalesce(F.nullif("failure_type", F.lit("")), F.lit("error"))).otherwise("")
    return done.groupBy("workflow", F.col("status").alias("outcome"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


def writes_by_status(writes: DataFrame) -> DataFrame:
    return writes.groupBy("target", "operation", "status").agg(F.count(F.lit(1)).alias("writes"))


def duration_histogram(writes: DataFrame, by: Sequence[str] = ("target", "operation")) -> DataFrame:
    """(by..., le, count) cumulative counts per upper bound; le is NULL for all."""
    bounds = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col("duration") <= b).alias("count")) for b in DURATION_BUCKETS]
    every = F.struct(F.lit(None).cast("double").alias("le"), F.count("duration").alias("count"))
    wide = writes.groupBy(*by).agg(F.array(*bounds, every).alias("_h"), F.sum("duration").alias("total"))
    return wide.select(*by, F.inline("_h"))


def events_by_arrival(events: DataFrame) -> DataFrame:
    return events.groupBy("workflow", "via").agg(F.count(F.lit(1)).alias("events"))


def metered_documents(writes: DataFrame) -> DataFrame:
    """Documents created per metered target."""
    counted = writes.filter(F.col("metered") & (F.col("status") == "committed"))
    return counted.groupBy("target").agg(F.count(F.lit(1)).alias("documents"))


def approvals_by_decision(decisions: DataFrame) -> DataFrame:
    """Decisions per workflow with how long people took; nobody in time is timed_out."""
    decision = F.when(F.col("decided_by") == TIMEOUT_ACTOR, "timed_out").otherwise(F.col("status"))
    return decisions.groupBy("workflow", decision.alias("decision")).agg(
        F.count(F.lit(1)).alias("approvals"), F.sum("wait_ms").alias("wait_ms"), F.max("wait_ms").alias("longest_ms")
    )


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs, newest first, with a note for pending and skipped ones."""
    note = F.when(F.col("status") == "running", "pending").when(F.col("skipped"), "skipped")
    return runs.orderBy(F.desc("started_ms"), F.desc("run_id")).limit(limit).withColumn("note", note)


def skipped_report(runs: DataFrame, limit: int) -> DataFrame:
    """How many of the newest runs were skipped, by reason."""
    newest = newest_runs(runs, limit)
    reason = F.when(F.col("skipped"), F.coalesce("failure_type", F.lit("unknown reference"))).otherwise("not skipped")
    return newest.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


def retained_log(slots: DataFrame) -> DataFrame:
    """Bytes of log each replication slot holds, from hexadecimal LSN text."""

    def lsn(c: str) -> Column:
        part = lambda i: F.conv(F.split_part(F.col(c), F.lit("/"), F.lit(i)), 16, 10).cast("bigint")
        return F.shiftleft(part(1), 32) + part(2)

    return slots.withColumn("retained_bytes", lsn("current_lsn") - lsn("restart_lsn"))


# --- Quantiles --------------------------------------------------------------------------


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], bits: int = 10) -> DataFrame:
    """(keys..., share, value): the element at index int(share * (n - 1)) of the sorted values.

    Values are whole numbers. Equal ones are counted first; ranks are then found in coarse
    ranges of 2^bits values, and only the ranges that hold a rank are looked into. No task
    sorts a key's rows.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.withColumn("_range", F.shiftright("_v", bits))
    coarse = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_rn"))
    up_to = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranks = coarse.withColumn("_to", F.sum("_rn").over(up_to)).withColumn("_all", F.sum("_rn").over(Window.partitionBy(*keys)))
    wanted = ranks.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    wanted = wanted.withColumn("_rank", F.floor(F.col("share") * (F.col("_all") - 1)))
    start = F.col("_to") - F.col("_rn")
    hit = wanted.filter((F.col("_rank") >= start) & (F.col("_rank") < F.col("_to"))).select(
        *keys, "_range", "share", (F.col("_rank") - start).alias("_rank")
    )
    inside = Window.partitionBy(*keys, "share").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    fine = ranged.join(hit, [*keys, "_range"]).withColumn("_to", F.sum("_n").over(inside))
    found = fine.filter((F.col("_rank") >= F.col("_to") - F.col("_n")) & (F.col("_rank") < F.col("_to")))
    return found.select(*keys, "share", F.col("_v").alias(value))


def run_latency(runs: DataFrame, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of active time per workflow: closed - started - waited, in milliseconds."""
    active = runs.filter(F.col("status") == "completed").select(
        "workflow", (F.col("closed_ms") - F.col("started_ms") - F.col("waited_ms")).alias("active_ms")
    )
    return exact_quantiles(active, ["workflow"], "active_ms", shares)


# --- Steward queue ----------------------------------------------------------------------


def newest_attempts(attempts: DataFrame) -> DataFrame:
    """One row per run: its newest attempt."""
    return first_by(attempts, ["run_id"], F.col("attempt"), last=True)


def unresolved_runs(attempts: DataFrame) -> DataFrame:
    """Runs whose newest attempt failed for want of a master record."""
    failed = (F.col("status") == "failed") & (F.col("failure_type") == "Unresolved") & (F.coalesce("ref", F.lit("")) != "")
    return newest_attempts(attempts).filter(failed)


def steward_queue(attempts: DataFrame) -> DataFrame:
    """Links that runs wait for, longest wait first, with the newest run's suggestions.

    The runs themselves stay rows of ``unresolved_runs``: a popular reference may hold up
    any number of them.
    """
    grouped = unresolved_runs(attempts).groupBy("entity", "system", "ref").agg(
        F.count(F.lit(1)).alias("runs"),
        F.min("closed_ms").alias("since"),
        F.max_by("suggestions", F.struct("closed_ms", "run_id")).alias("suggestions"),
        F.max(F.struct("closed_ms", "run_id"))["run_id"].alias("newest_run"),
    )
    return grouped.orderBy("since", "entity", "system", "ref")


# --- Circuit breakers -------------------------------------------------------------------


def breaker_openings(writes: DataFrame, failures: int = BREAKER_FAILURES) -> DataFrame:
    """Streaks of failed writes per target that would have opened its circuit.

    ``writes`` has a unique ``seq`` in time order. A success ends a streak; the circuit
    opens at the ``failures``-th failure in a row. Rows: target, streak start and end,
    failures, and when it opened.
    """
    marked = writes.select("target", "seq", "at_ms", F.coalesce(F.col("status") == "failed", F.lit(False)).alias("_bad"))
    rows = run_starts(marked, "seq", ["_bad"], "first_seq", ["target"]).filter("_bad")
    streak = ["target", "first_seq"]
    # Spark keeps no more than ``failures`` rows of a streak in a task before the shuffle.
    nth = F.row_number().over(Window.partitionBy(*streak).orderBy("seq"))
    opening = rows.withColumn("_nth", nth).filter(F.col("_nth") <= failures).filter(F.col("_nth") == failures)
    whole = rows.groupBy(*streak).agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("failures"))
    streaks = whole.join(opening.select(*streak, F.col("at_ms").alias("opened_ms")), streak)
    return streaks.withColumn(
        "trial_ms", F.col("opened_ms") + BREAKER_COOLDOWN_MS
    )


# --- Approvals --------------------------------------------------------------------------


def decide_approvals(requests: DataFrame, signals: DataFrame, timeout_ms: int, now_ms: int) -> DataFrame:
    """Each request's decision: approved, rejected or pending, by whom, after how long.

    ``requests`` is (workflow, run_id, step, digest, asked_ms), ``signals`` (run_id, step,
    digest, status, actor, at_ms). The first signal about exactly this request decides, any
    status but approved rejects, and nobody in time is a rejection by the timeout actor.
    """
    keys = ["run_id", "step", "digest"]
    answered = signals.join(requests.select(*keys, "asked_ms"), keys).filter(
        (F.col("at_ms") >= F.col("asked_ms")) & (F.col("at_ms") < F.col("asked_ms") + timeout_ms) & (F.col("at_ms") <= now_ms)
    )
    first = answered.groupBy(*keys).agg(F.min(F.struct("at_ms", "status", "actor")).alias("_s"))
    out = requests.join(first, keys, "left")
    late = F.lit(now_ms) >= F.col("asked_ms") + timeout_ms
    status = (
        F.when(F.col("_s").isNull(), F.when(late, "rejected").otherwise("pending"))
        .when(F.col("_s.status") == "approved", "approved")
        .otherwise("rejected")
    )
    by = F.when(F.col("_s").isNotNull(), F.col("_s.actor")).when(late, F.lit(TIMEOUT_ACTOR))
    wait = F.when(F.col("_s").isNotNull(), F.col("_s.at_ms") - F.col("asked_ms")).when(late, F.lit(timeout_ms))
    return out.withColumns({"status": status, "decided_by": by, "wait_ms": wait}).drop("_s")


# --- Alerts -----------------------------------------------------------------------------


def sliding_counts(events: DataFrame, keys: Sequence[str], counts: dict[str, Column], width_ms: int, slide_ms: int) -> DataFrame:
    """Counts per key and sliding window, named by the window's end.

    Rows are counted per slide first and only those counts are spread over the windows, so
    a window of many slides does not multiply the rows.
    """
    slot = (F.floor(F.col("at_ms") / slide_ms) * slide_ms).cast("bigint")
    per_slot = events.groupBy(*keys, slot.alias("_slot")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    ends = F.sequence(F.col("_slot") + slide_ms, F.col("_slot") + width_ms, F.lit(slide_ms))
    spread = per_slot.select(*keys, *counts, F.explode(ends).alias("window_end_ms"))
    return spread.groupBy(*keys, "window_end_ms").agg(*[F.sum(n).alias(n) for n in counts])


def failing_runs(runs: DataFrame, ratio: float, least: int = 3, width_ms: int = 60 * MINUTE, slide_ms: int = 5 * MINUTE) -> DataFrame:
    """Windows in which more than ``ratio`` of a workflow's finished runs failed, at least ``least``."""
    done = runs.filter(F.col("status").isin("completed", "failed")).withColumn("at_ms", F.col("closed_ms"))
    counts = {"finished": F.lit(True), "failed": F.col("status") == "failed"}
    windows = sliding_counts(done, ["workflow"], counts, width_ms, slide_ms)
    return windows.filter((F.col("failed") >= least) & (F.col("failed") / F.col("finished") > ratio))


def alert_windows(events: DataFrame, keys: Sequence[str], test: Column, width_ms: int, slide_ms: int = 5 * MINUTE, above: int = 0) -> DataFrame:
    """Sliding windows with more than ``above`` events of a kind, named by their end.

    What an alert sees when it looks back ``width_ms`` every ``slide_ms``: events on both
    sides of a full hour are in one window all the same.
    """
    kind = events.filter(F.coalesce(test, F.lit(False)))
    return sliding_counts(kind, keys, {"events": F.lit(True)}, width_ms, slide_ms).filter(F.col("events") > above)


def lasting(windows: DataFrame, keys: Sequence[str], for_ms: int, slide_ms: int = 5 * MINUTE) -> DataFrame:
    """Spells in which an alert's condition held at every look for ``for_ms``: (keys..., since_ms, fires_ms, last_ms).

    ``windows`` has the windows (by their end) in which the condition holds. A key has no
    more of them than there were looks, whatever its number of events.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("window_end_ms")).cast("bigint")
    spells = windows.select(*keys, "window_end_ms", (F.col("window_end_ms") - nth * slide_ms).alias("_spell"))
    found = spells.groupBy(*keys, "_spell").agg(F.min("window_end_ms").alias("since_ms"), F.max("window_end_ms").alias("last_ms"))
    return found.filter(F.col("last_ms") - F.col("since_ms") >= for_ms).select(*keys, "since_ms", (F.col("since_ms") + for_ms).alias("fires_ms"), "last_ms")


def slow_windows(
    runs: DataFrame, targets: DataFrame, width_ms: int = 30 * MINUTE, slide_ms: int = 5 * MINUTE, share: float = 0.95
) -> DataFrame:
    """Sliding windows in which a workflow's 95th percentile of active time is above its target.

    Times are counted per slide in classes an eighth of a doubling wide; such counts merge
    into those of windows and tell the class in which the percentile lies. Only the times of
    that class are looked at, which makes it exact.
    """
    active = F.col("closed_ms") - F.col("started_ms") - F.col("waited_ms")
    done = runs.filter(F.col("status") == "completed").select(
        "workflow", (F.floor(F.col("closed_ms") / slide_ms) * slide_ms).cast("bigint").alias("_slot"), active.alias("active_ms")
    )
    done = done.withColumn("_class", F.floor(F.log2(F.greatest(F.col("active_ms"), F.lit(0)) + 1) * 8).cast("int"))
    per_slot = done.groupBy("workflow", "_slot", "_class").agg(F.count(F.lit(1)).alias("_n"))
    ends = F.sequence(F.col("_slot") + slide_ms, F.col("_slot") + width_ms, F.lit(slide_ms))
    classes = per_slot.withColumn("window_end_ms", F.explode(ends)).groupBy("workflow", "window_end_ms", "_class").agg(F.sum("_n").alias("_n"))
    window = Window.partitionBy("workflow", "window_end_ms")
    below = F.coalesce(F.sum("_n").over(window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.floor(F.lit(share) * (F.sum("_n").over(window) - 1)).cast("bigint")
    placed = classes.withColumns({"_below": below, "_wanted": wanted})
    held = placed.filter((F.col("_below") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_below") + F.col("_n")))
    slots = F.sequence(F.col("window_end_ms") - width_ms, F.col("window_end_ms") - slide_ms, F.lit(slide_ms))
    looked = held.select("workflow", "window_end_ms", "_class", (F.col("_wanted") - F.col("_below")).alias("_nth"), F.explode(slots).alias("_slot"))
    nth = F.row_number().over(window.orderBy("active_ms")) - 1
    found = looked.join(done, ["workflow", "_class", "_slot"]).withColumn("_i", nth).filter("_i = _nth")
    return found.select("workflow", "window_end_ms", "active_ms").join(targets, "workflow").filter(F.col("active_ms") > F.col("target_ms"))


def stream_windows(
    events: DataFrame, keys: Sequence[str], counts: dict[str, Column], at: str, delay: str, width: str, slide: str
) -> DataFrame:
    """``sliding_counts`` of a stream, each window once ``delay`` has passed since its end.

    Two stateful steps: counts per slide, and windows of those. A row changes one count, not
    as many as a window has slides.
    """
    slots = events.withWatermark(at, delay).groupBy(F.window(at, slide).alias("_slot"), *keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    windows = slots.groupBy(F.window(F.window_time("_slot"), width, slide).alias("_window"), *keys).agg(*[F.sum(n).alias(n) for n in counts])
    return windows.select(*keys, F.unix_millis("_window.end").alias("window_end_ms"), *counts)


def counted_alert(events: DataFrame, keys: Sequence[str], test: Column, width_ms: int, above: int = 0) -> DataFrame:
    """Tumbling windows with more than ``above`` events of a kind: failed compensations,
    records waiting for a steward, approvals timing out, webhooks with bad signatures."""
    start = (F.floor(F.col("at_ms") / width_ms) * width_ms).cast("bigint")
    counted = events.filter(F.coalesce(test, F.lit(False))).groupBy(*keys, start.alias("window_ms")).agg(F.count(F.lit(1)).alias("events"))
    return counted.filter(F.col("events") > above)


def slow_runs(runs: DataFrame, targets: DataFrame, width_ms: int = 30 * MINUTE, share: float = 0.95) -> DataFrame:
    """Windows in which a workflow's 95th percentile of active time is above its target."""
    done = runs.filter(F.col("status") == "completed").select(
        "workflow", (F.floor(F.col("closed_ms") / width_ms) * width_ms).cast("bigint").alias("window_ms"),
        (F.col("closed_ms") - F.col("started_ms") - F.col("waited_ms")).alias("active_ms"),
    )
    found = exact_quantiles(done, ["workflow", "window_ms"], "active_ms", [share]).drop("share")
    return found.join(targets, "workflow").filter(F.col("active_ms") > F.col("target_ms"))


def stalled_polls(polls: DataFrame, now_ms: int, limit_ms: int) -> DataFrame:
    """Workflows whose source was last read longer ago than the limit."""
    last = polls.groupBy("workflow").agg(F.max("at_ms").alias("last_ms"))
    return last.filter(F.lit(now_ms) - F.col("last_ms") > limit_ms)


def failed_compensations(runs: DataFrame, width_ms: int = 15 * MINUTE) -> DataFrame:
    """Windows in which a workflow's run failed and could not undo its writes either."""
    done = runs.withColumn("at_ms", F.col("closed_ms"))
    return counted_alert(done, ["workflow"], F.col("failure_type") == "CompensationFailed", width_ms)


def retained_logs(samples: DataFrame, limit_bytes: int, lasting_ms: int = 15 * MINUTE) -> DataFrame:
    """Slots that made their database keep more log than the limit for longer than ``lasting_ms``.

    ``samples`` is (slot, at_ms, retained_bytes). A spell over the limit lasts until the next
    sample at or below it, or is still open; it is told by its first and last sample.
    """
    over = F.col("retained_bytes") > limit_bytes
    marked = samples.filter(~over).select("slot", F.col("at_ms").alias("_end"))
    order = Window.partitionBy("slot").orderBy("at_ms", F.col("_end").isNull())
    both = samples.filter(over).select("slot", "at_ms", F.lit(None).cast("bigint").alias("_end")).unionByName(
        marked.select("slot", F.col("_end").alias("at_ms"), "_end")
    )
    spelled = both.withColumn("_since", F.last("_end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spells = spelled.filter(F.col("_end").isNull()).groupBy("slot", "_since").agg(
        F.min("at_ms").alias("since_ms"), F.max("at_ms").alias("last_ms"), F.count(F.lit(1)).alias("samples")
    )
    return spells.filter(F.col("last_ms") - F.col("since_ms") > lasting_ms).drop("_since")
