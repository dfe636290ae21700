"""Row filters and ordering."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.missing import drop_nan, is_missing, not_in


def in_year(year: Column, wanted: int | str) -> Column:
    """Year equality; text such as "2023" is made a number here, so the column is not cast."""
    return year == int(wanted)


def exclude_pairs(first: Column, second: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Condition that drops the given value pairs.

    A missing value beside a listed one drops the row too, which an anti-join would keep. However
    many pairs there are, each column occurs only a few times: Spark copies a column's definition to
    every occurrence when it moves the filter towards the scan.
    """
    if not pairs:
        return F.lit(True)
    partners: dict[str, list[str]] = {}
    for one, other in pairs:
        partners.setdefault(other, []).append(one)
    if len(partners) == 1:
        return ~((second == pairs[0][1]) & first.isin(*[one for one, _ in pairs]))
    entries = [(F.lit(key), F.array(*map(F.lit, ones))) for key, ones in partners.items()]
    listed = F.element_at(F.create_map(*chain(*entries)), second)
    # ``listed`` is NULL for a second value in no pair, and such a row stays.
    beside_listed = F.coalesce(~F.array_contains(listed, first), listed.isNull())
    any_first = first.isin(*dict.fromkeys(one for one, _ in pairs))
    return F.when(second.isNull(), ~any_first).otherwise(beside_listed)


def exclude_within(
    group: Column, group_value: str, member: Column, members: Sequence[str]
) -> Column:
    """Condition that drops the listed members of one group and keeps all other groups."""
    return (group != group_value) | ((group == group_value) & not_in(member, members))


def absent_after_zero(before: Column, after: Column) -> Column:
    """True when ``before`` is 0 and ``after`` missing.

    Negated in a filter it also drops rows where both are missing, because NULL is not True.
    """
    return (drop_nan(before) == 0) & is_missing(after)


def order_rows(df: DataFrame, *names: str) -> DataFrame:
    """Ascending, byte-wise, missing values last."""
    return df.orderBy(*[F.asc_nulls_last(name) for name in names])
