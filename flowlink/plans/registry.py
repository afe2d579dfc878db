"""Registry of example queries and the derived tables they read.

A derived table is one SELECT that Spark and DuckDB both understand; ``{name}`` stands for
a driver table or another derived table. ``epoch_ms(col)`` is the one function the two
engines spell differently.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from flowlink.session import configure

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_NAME = re.compile(r"\{([a-z_]+)\}")
_MILLIS = re.compile(r"epoch_ms\(([a-z_.]+)\)")

DERIVED: dict[str, str] = {}


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The driver tables and the tables derived from them, read lazily.

    ``spread`` cuts each driver table into that many partitions first: they come as one
    small file each, which a single task would read.
    """

    def __init__(self, spark: SparkSession, folder: str, spread: int = 0):
        self.spark = configure(spark)
        self.folder = folder
        self.spread = spread
        self._seen: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in DERIVED:
                self._seen[name] = self.sql(DERIVED[name])
            else:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._seen[name] = df.repartition(self.spread) if self.spread else df
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(oracle(text, _Views(self)))


class _Views(dict):
    """Temporary views of driver tables, made when first asked for."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, name: str) -> str:
        place = hashlib.md5(f"{self.tables.folder}/{self.tables.spread}".encode()).hexdigest()[:12]
        view = f"flowlink_{place}_{name}"
        if not self.tables.spark.catalog.tableExists(view):
            self.tables[name].createOrReplaceTempView(view)
        self[name] = view
        return view


def derive(name: str, sql: str) -> None:
    DERIVED[name] = sql


def query(name: str, sql: str | None = None):
    """Registers ``fn(tables) -> DataFrame`` under a name, with the SQL it must agree with."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return add


def oracle(sql: str, views: Mapping[str, str] | None = None) -> str:
    """The SQL with every derived table it needs as a WITH clause.

    With ``views``, driver tables are read through those (Spark); without, they are views
    of the same name (DuckDB).
    """
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    def table(match: re.Match) -> str:
        name = match.group(1)
        if views is None or name in DERIVED:
            return name
        return views[name]

    millis = r"(epoch_us(\1) // 1000)" if views is None else r"unix_millis(cast(\1 as timestamp))"

    def plain(text: str) -> str:
        return _MILLIS.sub(millis, _NAME.sub(table, text))

    visit(sql)
    ctes = [f"{n} AS ({plain(DERIVED[n])})" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + ", " + body[5:]
    return "WITH " + ", ".join(ctes) + " " + body
