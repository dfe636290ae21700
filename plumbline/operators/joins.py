"""Joins in which missing keys match missing keys.

The joins themselves carry no broadcast hint. Spark broadcasts a side only when its size, from file
statistics or measured by adaptive execution, is under its threshold, and otherwise shuffles and
splits skewed partitions. Null-safe equality is still a hash or sort-merge key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import require_columns

# Parts that the rows of one key are dealt over when a whole table meets a lookup.
SALTS = 16


def _right_keys(right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column], list[str]]:
    require_columns(right, keys)
    renamed = {key: f"{key}__right" for key in keys}
    match = [F.col(key).eqNullSafe(F.col(other)) for key, other in renamed.items()]
    return right.withColumnsRenamed(renamed), match, list(renamed.values())


def semi_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left rows whose keys occur on the right."""
    require_columns(left, keys)
    right, match, _ = _right_keys(right.select(*keys), keys)
    return left.join(right, match, "left_semi")


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All left rows with the matching right columns; key columns appear once."""
    require_columns(left, keys)
    shared = set(left.columns) & set(right.columns) - set(keys)
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(sorted(shared))}")
    right, match, extra = _right_keys(right, keys)
    return left.join(right, match, "left").drop(*extra)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """``left_join`` to a lookup that whole tables meet, at every size of either.

    The left rows of a key are dealt over ``salts`` parts by a hash of all their columns, and the lookup has a
    row for each part, so that no task gets all rows of a key that holds much of the table. Should Spark
    find the lookup small enough to broadcast, the rows do not move at all. ``how="left_semi"`` keeps
    the left rows whose keys the lookup has.
    """
    if how not in ("left", "left_semi"):
        raise ValueError(f"unknown kind of lookup: {how}")
    require_columns(left, [*keys])
    shared = (set(left.columns) & set(lookup.columns) - set(keys)) if how == "left" else set()
    if shared:
        raise ValueError(f"columns on both sides: {', '.join(sorted(shared))}")
    part, other = _unused("part", left, lookup), _unused("other_part", left, lookup)
    right = lookup if how == "left" else lookup.select(*keys)
    right, match, extra = _right_keys(right, keys)
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = F.pmod(F.xxhash64(*[left[name] for name in left.columns]), F.lit(salts)).cast("int")
    joined = left.withColumn(part, spread).join(right, [F.col(part) == F.col(other), *match], how)
    return joined.drop(part, other, *extra)


def _unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {column for table in tables for column in table.columns}
    while name in taken:
        name += "_"
    return name


def unique_lookup(
    df: DataFrame, keys: Sequence[str], value: str, duplicates: str = "error"
) -> DataFrame:
    """Distinct (keys, value) rows for a lookup.

    A key with two values would multiply the rows joined to it, so by default it stops the
    query; ``duplicates="keep"`` lets it through.
    """
    if duplicates == "keep":
        return df.select(*keys, value).distinct()
    if duplicates != "error":
        raise ValueError(f"unknown duplicates rule: {duplicates}")
    one_value = F.min(value).eqNullSafe(F.max(value)) & F.count(value).isin(0, F.count(F.lit(1)))
    named = F.concat_ws(", ", *[F.col(key).cast("string") for key in keys])
    message = F.concat(F.lit(f"more than one {value} for "), named)
    return df.groupBy(*keys).agg(
        F.when(one_value, F.min(value)).otherwise(F.raise_error(message)).alias(value)
    )
