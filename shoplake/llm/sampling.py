"""Bounded samples that no task and no driver pays for by the size of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, key: Column, ties: list[Column], most: int, total: int) -> DataFrame:
    """The ``most`` rows with the least hashes (``key``, a 64-bit hash) of a table of ``total`` rows.

    Rows far above the expected cut are dropped before any are sent, so all
    tasks together send about 1.5 x ``most`` rows, not ``most`` each.
    """
    share = min(1.0, (1.5 * most + 200) / max(1, total))
    near = df.filter(key.cast("double") < F.lit((share - 0.5) * 2.0**64)) if share < 1 else df
    return near.orderBy(key, *ties).limit(most)
