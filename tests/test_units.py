"""Vectors and small cases for the operators SQL does not check."""

import base64
import hashlib
import hmac
import json
import random
import time
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlink.functions import documents as D
from flowlink.functions import prefix
from flowlink.functions import scalars as S
from flowlink.operators import audit, drift, inbox, ledger, linking, mapping, policy, reports
from flowlink.session import scratch
from flowlink.sources import change_topic as C
from flowlink.sources import messages, outbox, polling, records, webhooks
from flowlink.streaming import approvals
from flowlink.streaming import intake


def one(df):
    return df.collect()[0]


# --- Mapping and documents --------------------------------------------------------------


def test_all_compile_failures_are_reported_at_once(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(mapping.MappingError) as e:
        mapping.apply_mapping(df, [mapping.Field("x", F.col("nope")), mapping.Field("y", F.col("gone")), mapping.Field("z", F.col("a"))])
    assert "x:" in str(e.value) and "y:" in str(e.value) and "z:" not in str(e.value)


def test_numbers_as_text_have_no_exponent(spark):
    df = spark.createDataFrame([(1e15,), (0.00001,), (12.5,), (-3.0,), (123456789.25,), (None,)], "v double")
    got = [r[0] for r in df.select(S.string(F.col("v"), "double")).collect()]
    assert got == ["1000000000000000", "0.00001", "12.5", "-3", "123456789.25", None]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (12.345,)], "v double")
    assert [r[0] for r in df.select(S.rounded(F.col("v"), 0)).collect()][:3] == [0.0, 2.0, 2.0]
    assert one(df.filter("v = 12.345").select(S.rounded(F.col("v"), 2)))[0] == 12.34


def test_template_errors(spark):
    df = spark.createDataFrame([((None, [1]), ("x",))], "source struct<a:string,b:array<int>>, doc struct<c:string>")
    out = D.render(df, "{{ source.a }}{{source.b}}-{{ doc.c }}{{ doc.d }}", {"source": "source", "doc": "doc"})
    assert one(out)["key_error"] == "unresolved source.a, source.b (not a scalar), doc.d"
    blank = spark.createDataFrame([((" ",),)], "doc struct<c:string>")
    assert one(D.render(blank, "{{ doc.c }}", {"doc": "doc"}))["key_error"] == "rendered empty"


def test_snake_names():
    assert [D.snake(n) for n in ("netValue", "customerID", "iban2Code", "already_done")] == ["net_value", "customer_id", "iban2_code", "already_done"]


def test_policy_edges(spark):
    rows = [("high", [], False, 1.0, "approved"), ("low", [], True, 1.0, None), ("read", ["integration-reader"], True, 60000.0, None), (None, [], False, 1.0, None)]
    df = spark.createDataFrame(rows, "risk string, roles array<string>, agent boolean, amount double, approval string")
    d = policy.decide(F.col("risk"), F.col("roles"), F.col("agent"), F.col("amount"), F.col("approval"))
    got = [(r.d.allow, r.d.require_approval, r.d.denied) for r in df.select(d.alias("d")).collect()]
    assert got == [(True, True, False), (False, False, True), (True, True, False), (False, False, False)]


def test_purpose_keeps_personal_fields(spark):
    df = spark.createDataFrame([("a@b", "x")], "email string, name string")
    assert one(policy.mask_personal(df, "system-of-record-write"))["email"] == "a@b"
    assert one(policy.mask_personal(df, "preview"))["email"] == "***"


# --- Change topics ----------------------------------------------------------------------


def encode(n, size=None):
    size = size or max(1, (n.bit_length() + 8) // 8)
    return base64.b64encode(n.to_bytes(size, "big", signed=True)).decode()


def test_decimal_vectors(spark):
    numbers = [123456, -5, 0, -12800, 32767, 2**63 - 1, -(2**63), 10**37, -(10**37) - 1]
    df = spark.createDataFrame([(encode(n),) for n in numbers], "b string")
    got = [r[0] for r in df.select(C.decimal_text(F.col("b"), 2)).collect()]
    want = [f"{'-' if n < 0 else ''}{abs(n) // 100}.{abs(n) % 100:02d}" for n in numbers]
    assert got == want
    assert got[:5] == ["1234.56", "-0.05", "0.00", "-128.00", "327.67"]


def test_numbers_past_38_digits_stay_text(spark):
    n = -(10**45) - 7
    df = spark.createDataFrame([(encode(n), 3), (None, 3)], "b string, s int")
    got = [r[0] for r in df.select(C.wide_decimal("b", "s")).collect()]
    assert got == ["-1000000000000000000000000000000000000000000.007", None]
    assert one(df.limit(1).select(C.unscaled(F.col("b"))))[0] is None


def test_variable_scale_and_clock(spark):
    df = spark.createDataFrame([((encode(1234567), 3),), ((encode(-5), 0),), ((encode(7), -2),)], "v struct<value:string,scale:int>")
    got = [r[0] for r in df.select(C.logical_value(F.col("v"), "io.debezium.data.VariableScaleDecimal")).collect()]
    assert got == ["1234.567", "-5", "700"]
    nanos = spark.createDataFrame([(45_296_000_123_000,), (0,), (1,)], "n bigint")
    assert [r[0] for r in nanos.select(C.clock_text(F.col("n"))).collect()] == ["12:34:56.000123", "00:00:00", "00:00:00.000000001"]


def test_key_is_canonical(spark):
    keys = ['{"b":2,"a":1}', '{"a":1,"b":2}', '{"schema":{},"payload":{"b":2,"a":1}}', "plain"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = [r[0] for r in df.select(C.canonical_key(F.col("key"))).collect()]
    assert got == ["a=1,b=2"] * 3 + ["plain"]


# --- Feeds, polling and inbox -----------------------------------------------------------


def test_oversized_transactions_stop_the_read(spark):
    big = spark.range(outbox.MAX_INDEX + 1).select(F.lit(7).cast("bigint").alias("commit_lsn"), F.col("id").alias("seq"), F.lit("insert").alias("op"))
    feed = big.unionByName(big.filter("seq < 3").withColumn("commit_lsn", F.lit(8).cast("bigint")))
    assert [r["commit_lsn"] for r in outbox.oversized_transactions(feed).collect()] == [7]
    with pytest.raises(Exception, match="transaction 7 cannot be ordered: 32768 changes"):
        outbox.read_changes(feed).collect()
    # Past it, and up to the bound, all changes come.
    assert [r["event_id"] for r in outbox.read_changes(feed, after=8 << 15).orderBy("position").collect()] == [f"{8:016X}.{i}" for i in (1, 2, 3)]
    whole = feed.filter(f"commit_lsn = 8 OR seq < {outbox.MAX_INDEX}")
    assert outbox.read_changes(whole).count() == outbox.MAX_INDEX + 3


def test_unwanted_operations_count_in_the_index(spark):
    feed = spark.createDataFrame([(5, 1, "insert"), (5, 2, "update"), (5, 3, "insert")], "commit_lsn bigint, seq bigint, op string")
    got = outbox.read_changes(feed, ["insert"]).orderBy("position").collect()
    assert [r["tx_index"] for r in got] == [1, 3]


def items(spark, positions):
    return spark.createDataFrame([(i, p) for i, p in enumerate(positions)], "id bigint, position bigint")


@pytest.mark.parametrize(
    "positions, limit, want",
    [
        ([1, 1, 2, 2], 3, [1, 1]),  # the cut group waits
        ([1, 1, 1, 2], 2, [1, 1, 1]),  # a first group larger than the batch is taken whole
        ([1, 2], 2, [1, 2]),  # nothing is cut
        ([], 2, []),
        ([5, 5], 2, [5, 5]),
    ],
)
def test_strict_cursor_never_skips(spark, positions, limit, want):
    got = polling.poll_whole_positions(items(spark, positions), 0, limit)
    assert sorted(r["position"] for r in got.collect()) == want


def test_reading_on_and_on_takes_every_item_once(spark):
    rng = random.Random(3)
    all_items = items(spark, sorted(rng.randint(1, 20) for _ in range(60)))
    after, seen = 0, []
    while True:
        batch = polling.poll_whole_positions(all_items, after, 7).collect()
        if not batch:
            break
        seen += [r["id"] for r in batch]
        after = max(r["position"] for r in batch)
    assert sorted(seen) == list(range(60))


def test_narrowed_window_reports_its_gap(spark):
    got, gap = polling.narrow_window(items(spark, [1, 2, 3, 4, 5]), 0, 3)
    assert sorted(r["position"] for r in got.collect()) == [4, 5] and gap.collect()[0].asDict() == {"gap_from": 0, "gap_to": 3}
    got, gap = polling.narrow_window(items(spark, [4, 5]), 0, 3)
    assert got.count() == 2 and gap.count() == 0


def test_keep_first_is_idempotent(spark):
    df = spark.createDataFrame([("s", "1", 5, "late"), ("s", "1", 2, "early"), ("t", "1", 9, "x")], "source string, event_id string, arrived bigint, v string")
    first = inbox.keep_first(df)
    assert sorted(r["v"] for r in first.collect()) == ["early", "x"]
    assert inbox.keep_first(df, first).count() == 0


# --- Ordered computations across blocks -------------------------------------------------


@pytest.mark.parametrize("ending,size", [("\n", 120), ("\n", 1 << 20), ("\r\n", 200)])
def test_exports_with_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, ending, size):
    rng = random.Random(size)
    said = ["plain", "", 'a ""quote""', "two\nlines", "\n\n\n", "x" * 80, "comma, too", 'long\n""and""\n' * 15, "é😀"]
    rows = [(str(i), rng.choice(said), rng.choice(said)) for i in range(40)]
    lines = ["id,note,other", *[f'{i},"{a}","{b}"' for i, a, b in rows]]
    for n, part in enumerate((lines[:30], ['"id",note,other', *lines[30:]])):
        (tmp_path / f"p{n}.csv").write_bytes((ending.join(part) + ending * (n + 1)).encode())
    (tmp_path / "p2.csv").write_text("id,note,other")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in keep:
        spark.conf.set(k, str(size))
    try:
        got = records.read_export(spark, str(tmp_path), ["id", "note", "other"], 40)
        blocks = spark.read.text(str(tmp_path)).select(F.input_file_block_start()).distinct().count()
        assert sorted(map(tuple, got.collect())) == sorted((i, a.replace('""', '"'), b.replace('""', '"')) for i, a, b in rows)
        assert blocks > 8 or size > 300
        with pytest.raises(records.IncompleteExport):
            records.read_export(spark, str(tmp_path), ["id", "note", "other"], 41)
        with pytest.raises(Exception, match="header"):
            records.read_export(spark, str(tmp_path), ["id", "other", "note"]).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def orders_of(rng, sparse):
    """Dense numbers, gaps of every width, and numbers as far apart as log positions."""
    if sparse:
        return [-(1 << 40) + (i << 15) for i in range(400)]
    return sorted(rng.sample(range(1 << 20), 300)) + [(1 << 33) + i * 70000 for i in range(60)] + [(1 << 35) + i for i in range(20)]


def test_blocks_hold_rows_however_far_apart_their_numbers_are(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 16)
    monkeypatch.setattr(prefix, "LEVEL_BITS", 2)
    for step in (1, 7, 1 << 15, 1 << 40):
        df = spark.range(1000).select((F.col("id") * step + 5).alias("n"))
        cut = prefix.cut_of(df, "n")
        sizes = [r["count"] for r in df.groupBy(cut.block("n")).count().collect()]
        assert max(sizes) <= 32 and len(sizes) <= 130 and cut.levels in (2, 3)


@pytest.mark.parametrize("values,sparse,rows_,bits", [("ab", False, 1 << 16, 12), ("a", False, 4, 2), ("ab", True, 4, 2), ("a", True, 1, 1), ("ab", False, 1, 3)])
def test_runs_cross_blocks_and_groups(spark, monkeypatch, values, sparse, rows_, bits):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(prefix, "LEVEL_BITS", bits)
    rng = random.Random(8)
    orders = orders_of(rng, sparse)
    rows = [(n, rng.choice("kl"), rng.choice([*values * 6, None]) if values == "ab" else "a", n % 3) for n in orders]
    df = spark.createDataFrame(rows, "n bigint, k string, v string, other int").repartition(3)
    want, last = [], {}
    for n, k, v, other in rows:
        if k not in last or last[k][0] != v:
            last[k] = (v, n)
        want.append((n, k, v, other, last[k][1]))
    assert sorted(tuple(r) for r in prefix.run_starts(df, "n", ["v"], "start", ["k"]).collect()) == want


@pytest.mark.parametrize("sparse,rows_,bits", [(False, 1 << 16, 12), (False, 4, 2), (True, 2, 1)])
def test_prefix_computations_cross_blocks_and_groups(spark, monkeypatch, sparse, rows_, bits):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(prefix, "LEVEL_BITS", bits)
    rng = random.Random(5)
    orders = orders_of(rng, sparse)
    rows = [(n, rng.choice("ab"), rng.choice([None, None, n]), rng.randint(0, 3)) for n in orders]
    df = spark.createDataFrame(rows, "n bigint, k string, v bigint, x int")
    out = prefix.running_sum(df, "n", "x", "total", ["k"])
    out = prefix.carried(out, "n", "v", "last", ["k"])
    out = prefix.previous_row(out, "n", ["x"], ["k"])
    state = {k: [0, None, None] for k in "ab"}
    want = []
    for n, k, v, x in rows:
        total, last, before = state[k]
        total, last = total + x, last if v is None else v
        want.append((n, total, last, before))
        state[k] = [total, last, x]
    got = [(r["n"], r["total"], r["last"], r["prev_x"]) for r in out.orderBy("n").collect()]
    assert got == want


def test_exact_quantiles(spark):
    rng = random.Random(9)
    values = {k: [rng.choice([0, 5, rng.randint(-3000, 500000)]) for _ in range(n)] for k, n in (("a", 1), ("b", 400), ("c", 37))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v bigint")
    got = {(r["k"], r["share"]): r["v"] for r in reports.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    for k, vs in values.items():
        for p in (0.0, 0.5, 0.95, 1.0):
            assert got[k, p] == sorted(vs)[int(p * (len(vs) - 1))]


def test_breaker_streaks_are_exact(spark):
    rng = random.Random(2)
    rows = [(i * 997, rng.choice(["x", "y"]), "failed" if rng.random() < 0.7 else "committed", i * 1000) for i in range(400)]
    df = spark.createDataFrame(rows, "seq bigint, target string, status string, at_ms bigint")
    want, run = [], {}
    for seq, target, status, at in rows + [(0, "x", "end", 0), (0, "y", "end", 0)]:
        if status == "failed":
            run.setdefault(target, []).append((seq, at))
            continue
        streak = run.pop(target, [])
        if len(streak) >= 5:
            want.append((target, streak[0][0], streak[-1][0], len(streak), streak[4][1]))
    got = [(r["target"], r["first_seq"], r["last_seq"], r["failures"], r["opened_ms"]) for r in reports.breaker_openings(df).collect()]
    assert sorted(got) == sorted(want)


# --- Webhooks, messages, records --------------------------------------------------------


def test_hmac_equals_the_standard_library(spark):
    for key in (b"k", b"x" * 64, b"y" * 100):
        body = "héllo {}"
        secret = webhooks.secrets_table(spark, [webhooks.Secret("e", key)])
        got = one(secret.select(webhooks.hmac_sha256(F.col("inner"), F.col("outer"), F.lit(body))))[0]
        assert got == hmac.new(key, body.encode(), hashlib.sha256).hexdigest()


def test_bitmaps_of_any_width(spark):
    fields = [f"f{i}" for i in range(90)]
    text = hex((1 << 85) | (1 << 3) | 1)
    df = spark.createDataFrame([([text, "3-0x5", "9-0x1"],)], "b array<string>")
    got = one(df.select(messages.bitmap_fields(F.col("b"), fields, {3: ["x", "y", "z"]})))[0]
    assert got == ["f0", "f3", "f85", "f3.x", "f3.z"]


def test_export_must_be_complete(spark):
    path = scratch(spark, "export")
    spark.createDataFrame([("1", 'a "quoted"\nline'), ("2", "")], "id string, note string").write.csv(path, header=True, escape='"')
    assert records.read_export(spark, path, ["id", "note"], 2).filter("note = ''").count() == 1
    with pytest.raises(records.IncompleteExport):
        records.read_export(spark, path, ["id", "note"], 3)


# --- Links and ledger -------------------------------------------------------------------


def test_upsert_keeps_attributes_a_new_link_lacks(spark):
    schema = "entity string, system string, source_id string, master_id string, attributes map<string,string>"
    old = spark.createDataFrame([("E", "s", "1", "A", {"email": "x"})], schema)
    new = spark.createDataFrame([("E", "s", "1", "B", {}), ("E", "s", "2", "C", None)], schema)
    got = {r["source_id"]: (r["master_id"], r["attributes"]) for r in linking.upsert_links(old, new).collect()}
    assert got["1"] == ("B", {"email": "x"}) and got["2"][0] == "C"


def test_replacing_load_moves_links(spark):
    xref = spark.createDataFrame([("E", "s", "1", "A", {"email": "o@x.example"})], "entity string, system string, source_id string, master_id string, attributes map<string,string>")
    export = spark.createDataFrame([("1", "B", 1, "n@x.example")], "id string, master string, seq int, mail string")
    kept = linking.plan_load(export, xref, "E", "s", "id", "master", [("mail", "email")])
    moved = linking.plan_load(export, xref, "E", "s", "id", "master", [("mail", "email")], replace=True)
    assert one(kept.merged)["master_id"] == "A" and one(moved.merged)["master_id"] == "B"
    assert one(linking.load_counts(moved))["replaced"] == 1 and one(linking.load_counts(kept))["conflict"] == 1


def test_generation_of_a_key_that_looks_like_one(spark):
    requests = spark.createDataFrame([("t", "undo", "a"), ("t", "undo", "a~2"), ("t", "undo", "b")], "target string, compensation string, idempotency_key string")
    done = spark.createDataFrame([("t/undo/a#compensate", "done"), ("t/undo/a~2#compensate", "done")], "key string, status string")
    got = {r["idempotency_key"]: r["write_key"] for r in ledger.generations(requests, done).collect()}
    assert got == {"a": "a~3", "a~2": "a~2~2", "b": "b"}


def test_generations_take_the_first_gap_and_are_not_broadcast(spark):
    gaps = {"a": [1, 2, 4], "b": [2, 3], "c": list(range(1, 49)), "d": list(range(1, 50)), "e": [], "f": list(range(1, 51))}
    requests = spark.createDataFrame([("t", "undo", k) for k in [*gaps, None]], "target string, compensation string, idempotency_key string")
    keys = [(f"t/undo/{k}" + ("" if n == 1 else f"~{n}") + "#compensate", "done") for k, done in gaps.items() for n in done]
    out = ledger.generations(requests, spark.createDataFrame(keys, "key string, status string"))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["idempotency_key"]: (r["generation"], r["write_key"]) for r in out.collect()}
    assert got == {"a": (3, "a~3"), "b": (1, "b"), "c": (49, "c~49"), "d": (None, None), "e": (1, "e"), "f": (None, None), None: (1, None)}


def test_ledger_states(spark):
    requests = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), ("k3", 4), ("k4", 5)], "key string, arrived int")
    held = spark.createDataFrame([("k2", "done", 0), ("k3", "inflight", 98), ("k4", "inflight", 10)], "key string, status string, claimed_minute int")
    got = {(r["key"], r["arrived"]): r["ledger_state"] for r in ledger.split_requests(requests, held, 100, "arrived").collect()}
    assert got == {("k1", 1): "write", ("k1", 2): "duplicate", ("k2", 3): "duplicate", ("k3", 4): "blocked", ("k4", 5): "write"}


def test_open_request_rules():
    step = approvals.ledger_step
    state, holder, _ = step(None, "open", "a", 0, 10)
    assert holder is None
    state, holder, _ = step(state, "open", "b", 1, 11)
    assert holder == "a"
    state, holder, _ = step(state, "open", "c", 2, 12)
    state, holder, _ = step(state, "open", "b", 3, 13)
    assert state == ("a", 10, ["c", "b"])  # asking again makes it the newest waiter
    state, _, woken = step(state, "close", "c", 4, None)
    assert woken == [] and state == ("a", 10, ["b"])
    later, holder, _ = step(state, "open", "d", 10, 20)
    assert holder is None and later == ("d", 20, ["b"])  # past its time: taken over
    state, _, woken = step(state, "close", "a", 5, None)
    assert state is None and woken == ["b"]


# --- Audit and drift --------------------------------------------------------------------


def chain(n):
    lines, prev = [], audit.GENESIS
    for seq in range(1, n + 1):
        body = {"seq": seq, "time": "2024-01-01T00:00:00Z", "actor": "a", "action": "x", "data": {"n": seq}, "prev": prev, "hash": ""}
        text = json.dumps(body, separators=(",", ":"))
        prev = hashlib.sha256(text.encode()).hexdigest()
        lines.append((seq, text.replace('"hash":""', f'"hash":"{prev}"')))
    return lines


@pytest.mark.parametrize(
    "change, at, problem",
    [
        (lambda l: None, None, None),
        (lambda l: l.__setitem__(499, (500, l[499][1].replace('"n":500', '"n":501'))), 500, "content does not match"),
        (lambda l: l.pop(299), 301, "gap before"),
        (lambda l: l.__setitem__(9, (10, "{broken")), 10, "unreadable"),
        (lambda l: l.append(l[41]), 42, "repeated"),
        (lambda l: l.__setitem__(6, (7, l[7][1])), 7, "misplaced"),
    ],
)
def test_chain_of_a_thousand_entries(spark, change, at, problem):
    lines = chain(1000)
    change(lines)
    got = one(audit.verify(spark.createDataFrame(lines, "row_seq bigint, line string")))
    assert (got["broken_at"], got["problem"], got["last_seq"]) == (at, problem, 1000)


def catalog(spark, rows):
    return spark.createDataFrame([("e", o, s, f, t, n, r, w, ro) for o, s, f, t, n, r, w, ro in rows], drift.CATALOG)


def test_every_kind_of_change(spark):
    old = catalog(spark, [
        ("A", False, "gone", "text", 0, False, None, False), ("A", False, "typed", "text", 0, False, None, False),
        ("A", False, "free", "text", 0, True, None, False), ("A", False, "must", "text", 0, False, None, False),
        ("A", False, "short", "text", 20, False, None, False), ("A", False, "bound", "text", 0, False, None, False),
        ("A", False, "ro", "text", 0, False, None, False), ("S", True, "rare", "number", 0, False, None, False),
        ("S", True, "nulls", "", 0, False, None, False), ("Old", False, "x", "text", 0, False, None, False),
    ])
    new = catalog(spark, [
        ("A", False, "typed", "int", 0, False, None, False), ("A", False, "free", "text", 0, False, None, False),
        ("A", False, "must", "text", 0, True, "learned", False), ("A", False, "short", "text", 10, False, None, False),
        ("A", False, "bound", "text", 5, False, None, False), ("A", False, "ro", "text", 0, False, None, True),
        ("A", False, "fresh", "text", 0, True, None, False), ("S", True, "nulls", "string", 0, False, None, False),
        ("New", False, "x", "text", 0, False, None, False),
    ])
    got = {(r["object"], r["field"], r["kind"], r["breaking"]) for r in drift.diff(old, new).collect()}
    assert got == {
        ("A", "gone", "field-removed", True), ("A", "typed", "type-changed", True), ("A", "free", "no-longer-required", False),
        ("A", "must", "became-required", True), ("A", "short", "length-shrunk", True), ("A", "bound", "length-shrunk", True),
        ("A", "ro", "became-read-only", True), ("A", "fresh", "field-added", True), ("S", "rare", "field-not-seen", False),
        ("Old", None, "object-removed", True), ("New", None, "object-added", False),
    }


def test_equal_catalogs_have_equal_digests(spark):
    rows = [("A", False, f"f{i}", "text", 0, False, None, False) for i in range(20)]
    a, b = catalog(spark, rows), catalog(spark, rows[::-1])
    assert one(drift.digests(a)) == one(drift.digests(b))
    assert drift.diff(a, b).count() == 0


# --- Segments and alerts ----------------------------------------------------------------


def plain_tree(rows):
    """(level, path) of segments (own number, parent's number) in order, by a walk of one document."""
    out, texts = [], {}
    for own, parent in rows:
        named = next((v for k, v in texts.items() if k.lstrip("0") == parent.lstrip("0")), None) if parent.lstrip("0") else None
        place = (1, f"/{own}") if named is None else (named[0] + 1, f"{named[1]}/{own}")
        texts[own] = place  # a later namesake takes the children, its text stays where it was
        out.append(place)
    return out


def test_small_documents_are_placed_inside_a_row(spark, monkeypatch):
    numbers = ["000001", "1", " 2", "3", "0003", "", None]
    rows = [
        (None if d == 4 else f"D{d}", numbers[(k * 5 + d) % 7] if d % 2 else f"{k:06d}", f"S{k % 2}", numbers[(k * 3 + d) % 7] if d % 2 else f"{k // 2}", f"t{k}")
        for d in range(9) for k in range(d * 2 + 1)
    ]
    df = spark.createDataFrame(rows, "docnum string, segnum string, segment string, psgnum string, t string").withColumn("fields", F.create_map(F.lit("T"), "t"))

    def told():
        tree, tops = messages.segment_tree(df), messages.attach_children(df)
        found = [sorted(str(r) for r in x.withColumn("fields", F.map_entries("fields")).collect()) for x in (tree, tops)]
        return found, "Join" in tree._jdf.queryExecution().optimizedPlan().toString()

    inside, joined = told()
    assert not joined
    for most in (0, 6):  # all documents by joins, and the larger ones
        monkeypatch.setattr(messages, "IN_A_ROW", most)
        assert told() == (inside, True)
    assert len(inside[0]) == len([r for r in rows if r[0] is not None])


def test_segments_hang_together_across_rows(spark):
    rng = random.Random(6)
    documents = {
        "chain": [(f"{i + 1:06d}", f"{i:06d}") for i in range(70)],
        "wide": [("000001", "")] + [(f"{i:06d}", "1") for i in range(2, 300)],
        "odd": [("000001", "9"), ("000002", "000002"), ("000003", "2"), ("0004", "3"), ("000004", ""), ("000005", "4"), ("000006", None)],
    } | {f"r{k}": [(f"{i:06d}", str(rng.randint(0, i + 2))) for i in range(1, 40)] for k in range(5)}
    rows = [(d, own, parent, "S") for d, found in documents.items() for own, parent in found]
    df = spark.createDataFrame(rows, "docnum string, segnum string, psgnum string, segment string").withColumn("fields", F.create_map(F.lit("A"), "segnum")).repartition(4)
    got = {(r["docnum"], r["segnum"]): (r["level"], r["path"]) for r in messages.segment_tree(df).collect()}
    for name, found in documents.items():
        found = sorted(found)
        want = plain_tree([(own, parent or "") for own, parent in found])
        assert [got[name, own] for own, _ in found] == want, name
    twice = spark.createDataFrame([("d", "1", "", "A"), ("d", "1", "", "B"), ("d", "2", "1", "C")], "docnum string, segnum string, psgnum string, segment string")
    paths = sorted(r["path"] for r in messages.segment_tree(twice.withColumn("fields", F.create_map(F.lit("A"), "segment"))).collect())
    assert paths == ["/1", "/1", "/1/2"]


def test_alerts_look_across_full_hours(spark):
    minute, hour = 60_000, 3_600_000
    times = [10 * hour - 2 * minute, 10 * hour - 1 * minute, 10 * hour + minute]
    events = spark.createDataFrame([("w", t, True) for t in times] + [("w", 20 * hour, False)], "workflow string, at_ms bigint, bad boolean")
    assert reports.counted_alert(events, ["workflow"], F.col("bad"), hour, above=2).count() == 0
    windows = reports.alert_windows(events, ["workflow"], F.col("bad"), hour, 5 * minute, above=2)
    ends = sorted(r["window_end_ms"] for r in windows.collect())
    assert ends == [10 * hour + k * 5 * minute for k in range(1, 12)]
    spell = reports.lasting(windows, ["workflow"], 10 * minute).collect()
    assert [(r["since_ms"], r["fires_ms"], r["last_ms"]) for r in spell] == [(ends[0], ends[0] + 10 * minute, ends[-1])]
    assert reports.lasting(windows, ["workflow"], 2 * hour).count() == 0


def test_spells_of_more_looks_than_fit_an_int_of_milliseconds(spark):
    slide = 5 * reports.MINUTE
    windows = spark.range(1, 8001).select(F.lit("a").alias("workflow"), (F.col("id") * slide).alias("window_end_ms"))
    got = reports.lasting(windows, ["workflow"], 10 * reports.MINUTE).collect()
    assert [tuple(r) for r in got] == [("a", slide, slide + 10 * reports.MINUTE, 8000 * slide)]


def test_percentiles_of_sliding_windows_are_exact(spark):
    rng = random.Random(12)
    minute = 60_000
    rows = [(rng.choice("ab"), "completed", 1000 * minute + rng.randint(0, 90) * minute, rng.choice([0, 1, 5, 900, 1000, 1001, 70_000]) + rng.randint(0, 3)) for _ in range(300)]
    runs = spark.createDataFrame([(w, s, c, c - a, 0) for w, s, c, a in rows], "workflow string, status string, closed_ms bigint, started_ms bigint, waited_ms bigint")
    targets = spark.createDataFrame([("a", 950), ("b", -1)], "workflow string, target_ms bigint")
    want = set()
    for w, target in (("a", 950), ("b", -1)):
        for end in range(900 * minute, 1200 * minute, 5 * minute):
            times = sorted(a for v, _, c, a in rows if v == w and end - 30 * minute <= c < end)
            if times and times[int(0.95 * (len(times) - 1))] > target:
                want.add((w, end, times[int(0.95 * (len(times) - 1))], target))
    assert {tuple(r) for r in reports.slow_windows(runs, targets).select("workflow", "window_end_ms", "active_ms", "target_ms").collect()} == want


# --- Streams ----------------------------------------------------------------------------


def test_a_batch_delivered_again_changes_nothing(spark):
    path = scratch(spark, "inbox")
    schema = "source string, event_id string, arrived bigint"
    first = spark.createDataFrame([("s", "1", 1), ("s", "2", 2)], schema)
    second = spark.createDataFrame([("s", "2", 3), ("s", "3", 4)], schema)
    for batch, n in ((first, 0), (second, 1), (second, 1), (first, 0)):
        intake.deliver(batch, n, path)
    got = intake.read_inbox_table(spark, path)
    assert sorted((r["event_id"], r["arrived"]) for r in got.collect()) == [("1", 1), ("2", 2), ("3", 4)]


ARRIVAL = T.StructType().add("source", "string").add("event_id", "string").add("arrived", "long").add("extra", "string")


def arrive(spark, path, rows):
    spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(path)


def test_late_events_start_their_runs_and_repeats_do_not(spark):
    day, path, out = 86_400_000, scratch(spark, "events"), scratch(spark, "runs")
    for days in (30, 29, 31, 1, 30, 1):
        arrive(spark, path, [("s", str(days), days * day, None)])
    stream = intake.read_folder(spark, path, ARRIVAL, per_batch=1)
    intake.to_table(intake.start_runs(stream, F.lit("w"), "arrived", "7 days"), out, scratch(spark, "checkpoint"))
    assert sorted(r["run_id"] for r in spark.read.parquet(out).collect()) == ["w/1", "w/29", "w/30", "w/31"]


def test_the_first_of_a_batch_is_kept_and_nulls_come_last(spark):
    path, inbox, checkpoint = scratch(spark, "events"), scratch(spark, "inbox"), scratch(spark, "checkpoint")
    arrive(spark, path, [("s", "1", None, "none"), ("s", "1", 7, "late"), ("s", "1", 3, "first"), (None, "1", 5, "other"), ("s", None, 1, "odd"), ("s", None, 2, "odd")])
    intake.run_to_inbox(intake.read_folder(spark, path, ARRIVAL), inbox, checkpoint)
    got = {(r["source"], r["event_id"], r["arrived"], r["extra"]) for r in intake.read_inbox_table(spark, inbox).collect()}
    assert got == {("s", "1", 3, "first"), (None, "1", 5, "other"), ("s", None, 1, "odd")}


@pytest.mark.parametrize("most", [1 << 16, 1 << 30])
def test_rows_of_a_large_batch_are_ranked_once_and_held_in_part(monkeypatch, most):
    rng = random.Random(6)
    ranked = []
    if hasattr(intake, "pc"):
        sort = intake.pc.sort_indices
        monkeypatch.setattr(intake.pc, "sort_indices", lambda rows, **how: ranked.append(rows.num_rows) or sort(rows, **how))
        monkeypatch.setattr(intake, "HELD_BYTES", most)
    rows = [(None if rng.random() < 0.01 else f"s{rng.randint(0, 2)}", str(rng.randint(0, 150_000)), None if rng.random() < 0.1 else rng.randint(0, 9), i) for i in range(200_000)]
    rows = [(*r, hash(r[:2]) % 64) for r in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 500])], names=["source", "event_id", "arrived", "_tie", "_part"]) for at in range(0, len(rows), 500)]
    got = pa.Table.from_batches(list(intake._first_of_batch(["source", "event_id"], ["arrived", "_tie"])(iter(batches)))).to_pylist()
    assert sum(ranked) == len(rows) and (max(ranked) < 5000 if most < 1 << 20 else len(ranked) == 1)
    want = {}
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3])):
        want.setdefault(r[:2], r)
    assert sorted(map(str, (tuple(r.values()) for r in got))) == sorted(map(str, want.values()))


def test_batches_do_not_read_what_earlier_ones_wrote(spark):
    path, inbox, checkpoint = scratch(spark, "events"), scratch(spark, "inbox"), scratch(spark, "checkpoint")
    run = lambda: intake.run_to_inbox(intake.read_folder(spark, path, ARRIVAL, per_batch=1), inbox, checkpoint)
    arrive(spark, path, [("s", str(i), i, None) for i in range(5)])
    run()
    held = spark.read.parquet(f"{inbox}/batch=0").count()
    # Unreadable from now on: nine more batches, each with a repeat of the first, must not mind.
    for file in Path(inbox, "batch=0").glob("*.parquet"):
        file.write_bytes(b"not parquet")
        Path(file.parent, f".{file.name}.crc").unlink(missing_ok=True)
    for n in range(1, 10):
        arrive(spark, path, [("s", "0", 100 + n, None), ("s", str(10 * n), n, None)])
    run()
    folders = [str(f) for f in Path(inbox).glob("batch=*") if f.name != "batch=0"]
    later = [r["event_id"] for r in spark.read.schema(ARRIVAL).parquet(*folders).collect()]
    assert held == 5 and sorted(later, key=int) == [str(10 * n) for n in range(1, 10)]


def test_a_new_checkpoint_goes_on_beside_the_inbox(spark):
    path, inbox = scratch(spark, "events"), scratch(spark, "inbox")
    for n, rows in enumerate(([("s", "1", 1, None), ("s", "2", 2, None)], [("s", "3", 3, None)], [("s", "4", 4, None), ("s", "1", 9, None)])):
        arrive(spark, path, rows)
        for _ in range(2):  # every checkpoint is new, and reads everything again
            intake.run_to_inbox(intake.read_folder(spark, path, ARRIVAL, per_batch=1), inbox, scratch(spark, "checkpoint"))
    got = sorted((r["event_id"], r["arrived"]) for r in intake.read_inbox_table(spark, inbox).collect())
    assert got == [("1", 1), ("2", 2), ("3", 3), ("4", 4)]


def test_an_identity_is_forgotten_when_its_receipt_is_old(spark):
    path, out, checkpoint = scratch(spark, "events"), scratch(spark, "once"), scratch(spark, "checkpoint")
    for arrived in (5, 4, 3):
        arrive(spark, path, [("s", "1", arrived, None)])
        stream = intake.read_folder(spark, path, ARRIVAL, per_batch=1)
        intake.to_table(intake.once(stream, ["source", "event_id"], "arrived", "1 second"), out, checkpoint)
        time.sleep(2)
        arrive(spark, path, [("s", f"other{arrived}", arrived, None)])  # moves the time of receipt on
        intake.to_table(intake.once(intake.read_folder(spark, path, ARRIVAL, per_batch=1), ["source", "event_id"], "arrived", "1 second"), out, checkpoint)
    assert sorted(r["arrived"] for r in spark.read.parquet(out).collect() if r["event_id"] == "1") == [3, 4, 5]


def test_decisions_need_a_few_calls_for_all_runs_of_a_bucket():
    calls, held, timers = [], [], []

    class Store:
        def get(self):
            calls.append("get")
            return held[-1] if held else None

        def update(self, value):
            calls.append("update")
            held.append(value)

        def clear(self):
            calls.append("clear")
            held.clear()

        def getValueState(self, name, schema):
            return self

        def registerTimer(self, at):
            calls.append("timer")
            timers.append(at)

        def getCurrentWatermarkInMs(self):
            return self.now

    store = Store()
    decide = approvals.Decide(100, 1000)
    decide.init(store)
    asked = [(str(n), "request", 1, "d", None, None, n) for n in range(50)]
    signals = [(str(n), "signal", 1, "d" if n % 4 else "x", "approved" if n % 3 else "no", "p", n + late) for n in range(0, 60, 2) for late in (7, 3)]
    told = lambda rows: [pd.DataFrame(rows, columns=["run_id", "kind", "step", "digest", "status", "actor", "at_ms"])]
    decided = lambda parts: {tuple(r) for part in parts for r in part.astype(object).values.tolist()}
    fit = {n for n in range(0, 50, 2) if n % 4}
    assert decided(decide.handleInputRows((0,), told(signals + asked), store)) == {(n, "approved" if n % 3 else "rejected", "p", 3) for n in fit}
    assert decided(decide.handleInputRows((0,), told([r for r in signals + asked if int(r[0]) in fit]), store)) == set()
    assert timers == [100] and len(calls) == 4
    store.now = 120
    assert {r[0] for r in decided(decide.handleExpiredTimer((0,), store, None))} == {n for n in range(21) if n not in fit}
    store.now = 149
    assert {r[0] for r in decided(decide.handleExpiredTimer((0,), store, None))} == {n for n in range(21, 50) if n not in fit}
    store.now = 5000
    assert decided(decide.handleExpiredTimer((0,), store, None)) == set() and not held and len(calls) <= 12


def test_packed_digests_are_equal_only_for_equal_texts(spark):
    texts = ["", "ab", "AB", "abc", "\x01", "0" * 32, "00", "0", "é", "ab\n", None]
    got = [None if r[0] is None else bytes(r[0]) for r in spark.createDataFrame([(x,) for x in texts], "d string").select(approvals.packed(F.col("d"))).collect()]
    assert len(set(got)) == len(texts) and got[-1] is None and len(got[5]) == 17


def test_messages_are_sorted_in_more_parts_where_they_are_many(spark, monkeypatch):
    from flowlink.plans import load, registry, streams

    load()
    monkeypatch.setattr(streams, "PART_ROWS", 500)
    seen = []
    monkeypatch.setattr(streams.S, "to_table", lambda *a, run=streams.S.to_table: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or run(*a))
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, registry.QUERIES["t05_await_decisions"].run(t).collect()))
    assert seen[0] > streams.STATE_PARTS
    want = spark.sql(registry.oracle(registry.QUERIES["t05_await_decisions"].sql, registry._Views(t)).replace("min({'at_ms': g.at_ms, 'status': g.status, 'actor': g.actor})", "min(named_struct('at_ms', g.at_ms, 'status', g.status, 'actor', g.actor))"))
    assert got == sorted(map(tuple, want.collect()))


def test_stream_and_replay_of_open_requests_agree(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 3)}", i, f"r{rng.randint(0, 4)}", rng.choice(["open", "open", "close"]), i * 10, i * 10 + rng.randint(5, 60)) for i in range(120)]
    schema = T.StructType().add("key", "string").add("seq", "long").add("run", "string").add("kind", "string").add("at_ms", "long").add("until", "long")
    log = spark.createDataFrame(rows, schema)
    path, out = scratch(spark, "log"), scratch(spark, "answers")
    log.coalesce(1).write.parquet(path)
    intake.to_table(approvals.open_requests(intake.read_folder(spark, path, schema)), out, scratch(spark, "checkpoint"))
    streamed = spark.read.schema(approvals.ANSWER).parquet(out)
    replayed = approvals.replay_requests(log)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, replayed.collect()))
    state, want = {}, []
    for key, seq, run, kind, at, until in rows:
        state[key], holder, woken = approvals.ledger_step(state.get(key), kind, run, at, until)
        want.append((key, seq, run, kind, holder, ",".join(woken)))
    assert sorted(map(tuple, replayed.collect()), key=lambda r: r[1]) == want
