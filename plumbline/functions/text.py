"""Text helpers. Patterns are literal text, so nothing needs escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence only; ``F.replace`` would change them all."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def remove_first(text: Column, old: str) -> Column:
    """Remove the first occurrence only."""
    return replace_first(text, old, "")


def trim_whitespace(text: Column) -> Column:
    """Trim all Unicode whitespace at both ends; ``F.trim`` strips spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fiscal_label(year: Column) -> Column:
    """2023 is "FY23"."""
    return replace_first(year.cast("string"), "20", "FY")


def year_name(year: int) -> str:
    """The label :func:`fiscal_label` gives one year, as plain text."""
    return str(year).replace("20", "FY", 1)
