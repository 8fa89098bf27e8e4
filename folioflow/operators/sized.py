"""Sides of joins whose size is looked at before they go to every executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of terms that are sent to every executor, and query vectors that one pass over all rows takes, at most.
MOST_TERMS, QUERY_BLOCK = 500_000, 4096


def is_small(df: DataFrame, most: int) -> bool:
    """Whether the frame has at most so many rows; no more than one over are counted."""
    return df.limit(most + 1).count() <= most


def blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The frame in parts of about ``most`` rows by a hash of the key; whole if it has no more."""
    n = -(-df.count() // most)
    return [df] if n <= 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]
