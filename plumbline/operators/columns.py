"""Column selection. Names are matched case-sensitively, and a missing name is an error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def select_any_of(df: DataFrame, wanted: Sequence[str], must: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, in the wanted order, then the mandatory ones, each once."""
    require_columns(df, must)
    present = [name for name in wanted if name in df.columns]
    return df.select(*dict.fromkeys([*present, *must]))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; unlike ``df.drop``, a missing one is an error."""
    require_columns(df, names)
    return df.drop(*names)


def rename(df: DataFrame, **new_to_old: str) -> DataFrame:
    """``rename(df, new="old")``; unlike ``withColumnsRenamed``, a missing column is an error."""
    require_columns(df, list(new_to_old.values()))
    return df.withColumnsRenamed({old: new for new, old in new_to_old.items()})


def relocate(df: DataFrame, name: str, after: int) -> DataFrame:
    """Move a column to just behind the column now at position ``after`` (counted from 1)."""
    require_columns(df, [name])
    anchor = df.columns[after - 1]
    if anchor == name:
        return df
    order = [column for column in df.columns if column != name]
    order.insert(order.index(anchor) + 1, name)
    return df.select(*order)


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns one after another, so a later one may use an earlier one."""
    for name, column in columns.items():
        df = df.withColumn(name, column)
    return df
