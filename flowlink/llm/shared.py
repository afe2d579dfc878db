"""Tables written between jobs, in the folder every executor shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlink.session import scratch

FILTER_BITS = 24  # of the bitmap that says which hashes are wanted: 2 MB for up to half a million
MOST_FILTER_BITS = 27  # 16 MB, however many there are


def filter_bits(hashes: int) -> int:
    """Bits of a bitmap of which so many hashes fill a thirty-second, as far as ``MOST_FILTER_BITS`` go."""
    return max(FILTER_BITS, min(MOST_FILTER_BITS, (32 * hashes - 1).bit_length()))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A table written once and read again: later jobs start from it, whoever is lost."""
    path = scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap_of(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2 ** bits of a column ``h`` of hashes: what isn't in it isn't wanted.

    Its words are combined before the shuffle; at most 2 ** (bits - 6) of them reach the driver.
    """
    place = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")
    words = hashes.select(F.shiftright(place, 6).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def wanted(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be wanted."""
    bits = len(bitmap).bit_length() + 5  # 64 to a word
    at = hashes >> np.uint64(64 - bits)
    return ((bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
