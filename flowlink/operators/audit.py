"""The audit log: chain verification, newest entries, refusals.

Entries are stored as canonical JSON lines: seq, time, actor, action, data, prev, hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENESIS = "0" * 64
ENTRY = "seq bigint, time string, actor string, action string, data string, prev string, hash string"


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of JSON lines; ``readable`` is false for a line that is none."""
    parsed = lines.select("*", F.explode(F.array(F.from_json(line, ENTRY))).alias("_e"))
    names = ("seq", "time", "actor", "action", "data", "prev", "hash")
    out = parsed.withColumns({n: F.col("_e")[n] for n in names}).drop("_e")
    return out.withColumn("readable", F.col("seq").isNotNull() & F.col("hash").isNotNull())


def seal(line: Column) -> Column:
    """The hash an entry must have: SHA-256 of its line with an empty hash."""
    return F.sha2(F.regexp_replace(line, r'"hash":"[0-9a-f]*"\}$', '"hash":""}'), 256)


def broken_entries(entries: DataFrame, chain: Sequence[str] = (), row_seq: str = "row_seq") -> DataFrame:
    """(chain, seq, problem) of entries that do not follow their predecessor.

    ``entries`` has the stored ``row_seq`` and ``line``. Each entry is joined to the one a
    number before it, so a log of any length is verified in parallel; its content is
    checked where it lies, and only numbers and hashes are shuffled.
    """
    keys = [*chain, row_seq]
    parsed = parse(entries)
    content = parsed.readable & (F.col("hash") == seal(F.col("line")))
    slim = parsed.select(
        *keys, "prev", "hash", parsed.readable.alias("readable"),
        (F.col("seq") == F.col(row_seq)).alias("placed"), F.coalesce(content, F.lit(False)).alias("intact"),
    )
    one = slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"), F.min("prev").alias("prev"), F.min("hash").alias("hash"),
        F.min("readable").alias("readable"), F.min("placed").alias("placed"), F.min("intact").alias("intact"),
    )
    before = one.select(*chain, (F.col(row_seq) + 1).alias(row_seq), F.col("hash").alias("_before"))
    joined = one.join(before, keys, "left")
    first = F.col(row_seq) == 1
    problem = (
        F.when(~F.col("readable"), "unreadable")
        .when(~F.coalesce("placed", F.lit(False)), "misplaced")
        .when(F.col("copies") > 1, "repeated")
        .when(~first & F.col("_before").isNull(), "gap before")
        .when(F.col("prev") != F.when(first, F.lit(GENESIS)).otherwise(F.col("_before")), "does not link")
        .when(~F.col("intact"), "content does not match")
    )
    return joined.select(*keys, problem.alias("problem")).filter(F.col("problem").isNotNull())


def verify(entries: DataFrame, chain: Sequence[str] = (), row_seq: str = "row_seq") -> DataFrame:
    """The last entry and the first break (NULL when the chain holds), per chain."""
    last = entries.groupBy(*chain).agg(F.max(row_seq).alias("last_seq"), F.count(F.lit(1)).alias("entries"))
    found = broken_entries(entries, chain, row_seq)
    first = found.groupBy(*chain).agg(F.min(row_seq).alias("broken_at"), F.min_by("problem", row_seq).alias("problem"))
    if chain:
        return last.join(first, list(chain), "left")
    return last.withColumns({c: first.select(c).scalar() for c in ("broken_at", "problem")})


def tail(entries: DataFrame, limit: int) -> DataFrame:
    """The newest entries, newest first."""
    return entries.orderBy(F.desc("seq")).limit(limit)


def refusals(entries: DataFrame, target: str, since: Column) -> DataFrame:
    """(seq, at, operation, error) of a target's failed writes since a time."""
    failed = entries.filter((F.col("action") == "writeback.failed") & (F.col("time") > since))
    data = F.try_parse_json("data")
    get = lambda p: F.try_variant_get(data, f"$.{p}", "string")
    out = failed.select("seq", F.col("time").alias("at"), get("target").alias("_target"), get("operation").alias("operation"), get("error").alias("error"))
    return out.filter((F.col("_target") == target) & (F.coalesce("operation", F.lit("")) != "")).drop("_target")
