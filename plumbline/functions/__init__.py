"""Column helpers. Every helper builds a Spark expression; none is a UDF."""

from plumbline.functions.missing import drop_nan, is_in, is_missing, not_in
from plumbline.functions.numeric import (
    format_integer,
    format_percent,
    na_sum,
    percent_text,
    ratio,
    round_half_even,
)
from plumbline.functions.text import (
    fiscal_label,
    remove_first,
    replace_first,
    trim_whitespace,
    year_name,
)

__all__ = [
    "drop_nan",
    "fiscal_label",
    "format_integer",
    "format_percent",
    "is_in",
    "is_missing",
    "na_sum",
    "not_in",
    "percent_text",
    "ratio",
    "remove_first",
    "replace_first",
    "round_half_even",
    "trim_whitespace",
    "year_name",
]
