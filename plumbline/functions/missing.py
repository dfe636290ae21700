"""Missing values: NULL, and NaN for doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(number: Column) -> Column:
    """True for NULL and for NaN. For text, use ``isNull()``."""
    return number.isNull() | F.isnan(number)


def drop_nan(number: Column) -> Column:
    """The number as a double, with NaN turned into NULL."""
    return F.nanvl(number.cast("double"), F.lit(None).cast("double"))


def is_in(value: Column, members: Sequence) -> Column:
    """Membership that is False, never NULL, for a missing value."""
    return F.coalesce(value.isin(*members), F.lit(False))


def not_in(value: Column, members: Sequence) -> Column:
    """Negated membership that keeps missing values, which ``~isin`` would lose."""
    return ~is_in(value, members)
