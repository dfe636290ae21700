"""Sums, ratios, rounding and number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.missing import drop_nan, is_missing

INFINITY = math.inf

# A double holds 15 decimal digits, so beyond this there is nothing left to round.
EXACT_DIGITS = 1e15


def na_sum(measure: Column) -> Column:
    """Aggregate: sum of the values present, 0 when there are none."""
    return F.coalesce(F.sum(drop_nan(measure)), F.lit(0.0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """IEEE division: x/0 is signed infinity and 0/0 is NaN; NULL if either side is NULL."""
    over_zero = F.signum(numerator) * F.lit(INFINITY)
    return (
        F.when(numerator.isNull() | denominator.isNull(), F.lit(None).cast("double"))
        .when(denominator != 0, numerator / denominator)
        .otherwise(over_zero)
    )


def round_half_even(number: Column, digits: int = 0) -> Column:
    """Round to the nearer of the two neighbouring doubles, and to the even one on a tie.

    Spark's ``round`` goes half up (0.125 gives 0.13) and ``bround`` works on the decimal text
    (2.675 gives 2.68); here 0.125 gives 0.12 and 2.675, a double just below, gives 2.67.
    """
    if digits == 0:
        return F.rint(number)
    scale = 10.0**digits
    below, above = F.floor(number * scale), F.ceil(number * scale)
    low, high = below / F.lit(scale), above / F.lit(scale)
    to_low, to_high = number - low, high - number
    take_low = (to_low < to_high) | ((to_low == to_high) & (below % 2 == 0))
    return F.when(
        F.abs(number) < EXACT_DIGITS / scale, F.when(take_low, low).otherwise(high)
    ).otherwise(number)


def _finite_or_infinity_text(number: Column, finite: Column) -> Column:
    infinity = F.when(number > 0, F.lit("Inf")).otherwise(F.lit("-Inf"))
    text = F.when(F.abs(number) == INFINITY, infinity).otherwise(finite)
    return F.when(~is_missing(number), text)


def percent_text(percent: Column) -> Column:
    """A whole percent as text: -20.0 is "-20%", infinity is "Inf%", missing stays NULL."""
    # Past the bigint range the cast would fail, so such a number keeps its double form.
    digits = F.when(
        F.abs(percent) < 1e18, F.rint(percent).cast("bigint").cast("string")
    ).otherwise(percent.cast("string"))
    return F.concat(_finite_or_infinity_text(percent, digits), F.lit("%"))


def _grouped(number: Column) -> Column:
    # Adding 0.0 turns the -0.0 that rint gives for -0.3 into 0.0, which prints without a sign.
    return F.format_number(F.rint(number) + F.lit(0.0), 0)


def format_integer(number: Column) -> Column:
    """Whole number with thousands separators, e.g. 12345.5 is "12,346"."""
    return _finite_or_infinity_text(number, _grouped(number))


def format_percent(fraction: Column) -> Column:
    """Fraction as a whole percent, e.g. 0.18 is "18%"."""
    text = _finite_or_infinity_text(fraction, _grouped(fraction * 100))
    return F.concat(text, F.lit("%"))
