"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A table to broadcast if it has at most ``most`` rows, else the table as it is.

    For tables of one row per topic partition or segment type: their size is looked at, and
    past the bound the join shuffles like any other.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
