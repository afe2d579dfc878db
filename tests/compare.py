"""Runs registered queries next to their SQL oracle in DuckDB and compares the rows.

``python -m tests.compare [--sf DIR] [name-prefix ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import re
import sys
import time

import duckdb

import __spark_entry__ as contract
from flowlink.plans.registry import DRIVER_TABLES
from flowlink.session import local_session


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal, float)):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return round(number, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


# Queries that SQL can't express, and the test that holds each against plain Python, brute
# force, an exact round trip or held-out labels.
CHECKED_BY = {
    "op1_sentencepiece": "tests/llm/test_pieces.py",
    "op2_url_filter": "tests/llm/test_urls.py",
    "op3_context_tree": "tests/llm/test_context_tree.py",
    "op5_secrets": "tests/llm/test_secrets.py",
    "op6_toxicity": "tests/llm/test_models.py",
    "op7_line_dedup": "tests/llm/test_lines.py",
    "op8_quality_classifier": "tests/llm/test_models.py",
    "op9_quality_rules": "tests/llm/test_rules.py",
    "op11_bestfit_packing": "tests/llm/test_packing.py",
    "pipeline": "tests/llm/test_pipeline.py",
}

OPERATOR = re.compile(r"op[0-9]+_")

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def check(spark, con, name, fn, sql, folder):
    """Returns (problem or None, number of rows)."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        test = CHECKED_BY.get(name)
        return (None if test and os.path.exists(test) else "it has no SQL to agree with, and no test of its own"), len(got)
    con.execute(sql)
    columns = [d[0] for d in con.description]
    want = rows_of(columns, con.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = [f"{c}: {t} vs {types[c]}" for c, t in df.dtypes if t in KINDS and KINDS[t] != types[c]]
    if odd:
        print(f"      note {name}: types {odd}")
    if got != want:
        wanted, given = set(want), set(got)
        only_got = [r for r in got if r not in wanted][:2]
        only_want = [r for r in want if r not in given][:2]
        return f"{len(got)} rows vs {len(want)}; spark only {only_got}; sql only {only_want}", len(got)
    return None, len(got)


def connect(folder):
    con = duckdb.connect()
    for table in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    spark, con = local_session("compare"), connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            problem, n = check(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001 - report and go on with the other queries
            problem, n = f"{type(e).__name__}: {str(e)[:500]}", -1
        mark = "ok  " if problem is None else "FAIL"
        empty = " EMPTY" if n == 0 else ""
        print(f"{mark} {name} rows={n}{empty} {'' if name in oracles else '(rows only) '}{time.time() - start:.1f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
