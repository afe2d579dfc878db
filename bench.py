"""Times the headline jobs on a folder of driver tables and prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from flowlink.operators import linking as L
from flowlink.plans import load
from flowlink.plans.registry import QUERIES, Tables
from flowlink.session import local_session, scratch

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered queries, each written to nowhere; their rows are all computed.
HEADLINE = (
    "governed_order_writes",
    "change_topic_to_inbox",
    "s09_change_identity",
    "s02_change_feed",
    "s20_webhook_intake",
    "s23_change_pointers",
    "k01_keep_first",
    "k09_ledger_split",
    "j01_exact_resolve",
    "i05_suggest",
    "i07_resolve_documents",
    "a02_run_latency",
    "w08_breaker_openings",
    "t07_failing_runs",
    "d03_annotate_changes",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return round(time.perf_counter() - start, 3)


def link_loads(t: Tables) -> dict[str, float]:
    """A load of one link per order into an empty cross-reference, and the same load again."""
    export = t["orders"].select(
        F.col("o_orderkey").cast("string").alias("account"),
        F.concat(F.lit("M-"), F.col("o_custkey").cast("string")).alias("master"),
        F.concat(F.lit("U"), F.col("o_orderkey").cast("string"), F.lit("@Shop.Example")).alias("email"),
        F.col("o_orderkey").alias("seq"),
    )
    match = [("email", "email"), ("email", "domain")]
    path = scratch(t.spark, "xref")
    schema = "entity string, system string, source_id string, master_id string, attributes map<string,string>"
    empty = t.spark.createDataFrame([], schema)

    def first():
        planned = L.plan_load(export, empty, "Account", "crm", "account", "master", match)
        planned.merged.write.parquet(path)
        return L.load_counts(planned, t.spark.read.parquet(path)).collect()

    def again():
        # The counts of a dry run say an unchanged export has nothing to write.
        current = t.spark.read.schema(schema).parquet(path)
        planned = L.plan_load(export, current, "Account", "crm", "account", "master", match)
        if L.load_counts(planned).collect()[0]["written"]:
            planned.merged.write.parquet(path + "-again")

    return {"k15_link_load_first": timed(first), "k15_link_load_unchanged": timed(again)}


def main() -> None:
    spark = local_session("bench", CPUS)
    load()
    spread = int(CPUS)
    t = Tables(spark, FOLDER, spread)
    drain(QUERIES["governed_order_writes"].run(t))  # warm-up: class loading is not the job
    times = {name: timed(lambda n=name: drain(QUERIES[n].run(Tables(spark, FOLDER, spread)))) for name in HEADLINE}
    times |= link_loads(t)
    orders, records = t["orders"].count(), t["change_topic"].count()
    print(
        json.dumps(
            {
                "metric": "headline jobs, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "rates": {
                    "governed_orders_per_sec": round(orders / times["governed_order_writes"]),
                    "change_records_per_sec": round(records / times["change_topic_to_inbox"]),
                    "links_first_per_sec": round(orders / times["k15_link_load_first"]),
                    "links_unchanged_per_sec": round(orders / times["k15_link_load_unchanged"]),
                },
            }
        )
    )


if __name__ == "__main__":
    main()
