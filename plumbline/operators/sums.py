"""Grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from plumbline.functions.numeric import na_sum


def sum_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum each measure per key, ignoring missing values.

    Each task sums its own rows first, so a key holding much of the table sends one row per task
    through the shuffle.
    """
    return df.groupBy(*keys).agg(*[na_sum(df[name]).alias(name) for name in measures])
