"""Logic plugins: user functions that read granted fields and propose changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 50.0


def granted(tables: Mapping[str, DataFrame], grants: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """The tables a plugin may see, with only the granted fields."""
    return {name: tables[name].select(*fields) for name, fields in grants.items()}


def run_plugin(
    plugin: Callable[[Mapping[str, DataFrame]], DataFrame],
    tables: Mapping[str, DataFrame],
    grants: Mapping[str, Sequence[str]],
) -> DataFrame:
    """A plugin's proposals (entity, record_id, patch): nothing else leaves it.

    Proposals go through policy and the ledger like any other write.
    """
    return plugin(granted(tables, grants)).select("entity", "record_id", "patch")


def credit_check(orders: DataFrame, customers: DataFrame, scores: DataFrame) -> DataFrame:
    """Orders approved when within the customer's limit and the score is at least 50.

    A missing score does not block; a missing limit sends the order to review.
    """
    joined = orders.join(customers.select("customer_id", "credit_limit"), "customer_id", "left").join(
        scores.select("customer_id", "score"), "customer_id", "left"
    )
    within = F.coalesce(F.col("net_value") <= F.col("credit_limit"), F.lit(False))
    sound = F.coalesce(F.col("score") >= MIN_SCORE, F.lit(True))
    return joined.withColumn("credit_status", F.when(within & sound, "approved").otherwise("review"))
