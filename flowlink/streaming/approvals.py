"""Approvals as keyed state: waiting for a decision, and one open request per write."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from flowlink.operators.reports import TIMEOUT_ACTOR

DECISION = (
    T.StructType().add("run_id", "long").add("status", "string").add("decided_by", "string").add("wait_ms", "long")
)
MESSAGE = "run_id bigint, kind string, step int, digest string, status string, actor string, at_ms bigint"


KEEP_MS = 7 * 86_400_000


BUCKETS = 1 << 12  # of runs; the state of a bucket is read and written as one value


class Decide(StatefulProcessor):
    """Holds a run's pending request until a matching signal comes or its time is over.

    Runs are kept by bucket, as each access is a call to the state store: one value per
    bucket, read and written once per trigger, and one timer at the first time at which one
    of its runs is due. A decided run is remembered for ``keep_ms`` past its time, so that
    messages delivered again change nothing, and then forgotten; so are signals whose
    request never came.
    """

    STATE = (
        "runs array<struct<run_id:bigint,closed:boolean,step:int,digest:binary,asked_ms:bigint,until:bigint,"
        "early:array<struct<step:int,digest:binary,status:string,actor:string,at_ms:bigint>>>>"
    )

    def __init__(self, timeout_ms: int, keep_ms: int = KEEP_MS):
        self.timeout_ms = timeout_ms
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("approvals", self.STATE)

    def _read(self) -> dict:
        """Per run: (closed, request or None, until, signals before it); due at ``until``."""
        known = self.state.get()
        return {} if known is None else {
            r[0]: (r[1], None if r[4] is None else (r[2], r[3], r[4]), r[5], [tuple(e) for e in r[6] or []]) for r in known[0] or []
        }

    def _write(self, runs: dict, before: int | None) -> None:
        """``before`` is when the bucket's timer was due, if it still waits."""
        if not runs:
            self.state.clear()
            return
        self.state.update(([(run, closed, *(request or (None, None, None)), until, early) for run, (closed, request, until, early) in runs.items()],))
        due = min(until for _, _, until, _ in runs.values())
        if before is None or due < before:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, came, out = self._read(), {}, []
        before = min((until for _, _, until, _ in runs.values()), default=None)
        for part in rows:
            columns = [part[c].tolist() for c in ("run_id", "kind", "step", "digest", "status", "actor", "at_ms")]
            for run, kind, step, digest, status, actor, at in zip(*columns):
                run, step, at = None if run is None else int(run), None if pd.isna(step) else int(step), int(at)
                known = runs.get(run, (False, None, 0, []))
                if known[0]:
                    continue
                # Signals may come before their request, in another order of the same moment.
                request, signals = came.setdefault(run, [known[1], [*known[3]]])
                if kind == "request":
                    came[run][0] = step, digest, at
                else:
                    signals.append((step, digest, status, actor, at))
        for run, (request, signals) in came.items():
            if request is None:
                runs[run] = False, None, max(s[4] for s in signals) + self.keep_ms, signals
                continue
            step, digest, asked = request
            end = asked + self.timeout_ms
            fits = [s for s in signals if s[0] == step and s[1] == digest and asked <= s[4] < end]
            if fits:
                _, _, status, actor, at = min(fits, key=lambda s: (s[4], s[2], s[3]))
                runs[run] = True, None, end + self.keep_ms, []
                out.append((run, "approved" if status == "approved" else "rejected", actor, at - asked))
            else:
                runs[run] = False, request, end, []
        if came:
            self._write(runs, before)
        yield self._decisions(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for run, (closed, request, until, early) in self._read().items():
            if until > now:
                left[run] = closed, request, until, early
            elif not closed and request is not None:
                left[run] = True, None, until + self.keep_ms, []
                out.append((run, "rejected", TIMEOUT_ACTOR, self.timeout_ms))
        self._write(left, None)
        yield self._decisions(out)

    def _decisions(self, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=DECISION.names)
        return made.astype({"run_id": "Int64", "wait_ms": "Int64"})

    def close(self) -> None:
        pass


def packed(digest: Column) -> Column:
    """A text as bytes that are equal only for equal texts: lower-case hex digits by the pair."""
    hexed = digest.rlike(r"\A([0-9a-f]{2})+\z")
    return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(digest))).otherwise(F.concat(F.lit(b"\x00"), F.encode(digest, "UTF-8")))


def await_decisions(messages: DataFrame, timeout_ms: int, delay: str = "1 minute") -> DataFrame:
    """A stream of decisions from a stream of requests and signals (see ``MESSAGE``).

    The first signal about exactly the pending request decides; without one in time, event
    time rejects it. To be started with RocksDB as its state store (``intake.started``).
    """
    timed = messages.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS))
    # As text, a run's number stays whole beside NULLs.
    keyed = timed.withColumns({"_bucket": bucket, "run_id": F.col("run_id").cast("string"), "digest": packed(F.col("digest"))})
    return keyed.groupBy("_bucket").transformWithStateInPandas(
        Decide(timeout_ms), outputStructType=DECISION, outputMode="Append", timeMode="EventTime"
    )


# --- One open request per write ---------------------------------------------------------

ANSWER = (
    T.StructType()
    .add("key", "string").add("seq", "long").add("run", "string").add("kind", "string")
    .add("holder", "string").add("waiters", "string")
)


def ledger_step(state, kind: str, run: str, at: int, until: int | None):
    """(new state, holder, waiters) after one message; a state is (holder, until, waiters).

    Opening gives the holder the run has to wait for, or NULL when it holds the request
    itself: the first run, the holder asking again, or whoever finds it past its time.
    Closing by the holder ends the request and wakes the waiters, newest last.
    """
    if kind == "open":
        if state is None:
            return (run, until, []), None, []
        holder, end, waiters = state
        others = [w for w in waiters if w != run]
        if holder == run or end <= at:
            return (run, until, others), None, []
        return (holder, end, others + [run]), holder, []
    if state is None:
        return None, None, []
    holder, end, waiters = state
    if holder == run:
        return None, None, waiters
    return (holder, end, [w for w in waiters if w != run]), None, []


class OpenRequests(StatefulProcessor):
    """The ledger of open requests, a key at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.request = handle.getValueState("request", "holder string, until bigint, waiters array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = None
        if self.request.exists():
            holder, until, waiters = self.request.get()
            state = (holder, until, list(waiters))
        # A trigger's messages of one key: a handful, put into their order.
        for r in sorted(rows, key=lambda r: r.seq):
            state, holder, woken = ledger_step(state, r.kind, r.run, r.at_ms, r.until)
            yield Row(key=key[0], seq=r.seq, run=r.run, kind=r.kind, holder=holder, waiters=",".join(woken))
        if state is None:
            self.request.clear()
        else:
            self.request.update(state)

    def close(self) -> None:
        pass


def open_requests(messages: DataFrame) -> DataFrame:
    """A stream of answers from a stream of (key, seq, run, kind, at_ms, until).

    To be started with RocksDB as its state store (``intake.started``).
    """
    return messages.groupBy("key").transformWithState(
        OpenRequests(), outputStructType=ANSWER, outputMode="Append", timeMode="None"
    )


def replay_requests(messages: DataFrame) -> DataFrame:
    """The same answers for a whole log: rows sorted by key and order, read in one pass.

    Only the current key's small state is held, however long its history is.
    """

    def replay(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if r.key != key:
                    key, state = r.key, None
                until = None if pd.isna(r.until) else int(r.until)
                state, holder, woken = ledger_step(state, r.kind, r.run, int(r.at_ms), until)
                out.append((r.key, int(r.seq), r.run, r.kind, holder, ",".join(woken)))
            yield pd.DataFrame(out, columns=ANSWER.names)

    ordered = messages.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(replay, ANSWER)
