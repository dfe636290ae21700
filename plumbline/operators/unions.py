"""Unions by column name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _compatible(one: T.DataType, other: T.DataType) -> bool:
    both_numbers = isinstance(one, T.NumericType) and isinstance(other, T.NumericType)
    missing_only = isinstance(one, T.NullType) or isinstance(other, T.NullType)
    return one == other or both_numbers or missing_only


def bind_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Append rows; a column absent on one side becomes missing there.

    Text against number is an error here, where Spark would coerce and fail only at run time.
    """
    for name in top.columns:
        if name in bottom.columns:
            one, other = top.schema[name].dataType, bottom.schema[name].dataType
            if not _compatible(one, other):
                raise TypeError(f"column {name}: {one.simpleString()} and {other.simpleString()}")
    return top.unionByName(bottom, allowMissingColumns=True)


def union_strict(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Append rows; both sides must have the same column names."""
    if set(top.columns) != set(bottom.columns):
        differing = sorted(set(top.columns) ^ set(bottom.columns))
        raise ValueError(f"columns on one side only: {', '.join(differing)}")
    return bind_rows(top, bottom)
