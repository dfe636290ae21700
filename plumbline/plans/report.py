"""Report sections, headings and number formats as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import format_integer, format_percent
from plumbline.operators import drop_columns
from plumbline.plans.compare import change_names, shown_columns
from plumbline.plans.profiles import Profile

# Subtitles of the two tables in a report.
SUBTITLES = {"all": "All Populations", "key": "Key Populations"}


def in_section(section: str) -> Column:
    """Whether a comparison row belongs to a section; KP_PREV belongs to both."""
    if section == "all":
        return (F.col("all_or_KP") == "Age/Sex") | (F.col("indicator") == "KP_PREV")
    if section == "key":
        return F.col("all_or_KP") == "KeyPop"
    raise ValueError(f"unknown section: {section}")


def section(comparison: DataFrame, name: str) -> DataFrame:
    """The comparison rows of one section."""
    return comparison.where(in_section(name))


def both_sections(comparison: DataFrame) -> DataFrame:
    """Every row once per section it belongs to, from one pass over the comparison."""
    memberships = F.array_compact(
        F.array(*[F.when(in_section(name), F.lit(name)) for name in SUBTITLES])
    )
    return comparison.withColumn("section", F.explode(memberships))


def format_numbers(rows: DataFrame, profile: Profile) -> DataFrame:
    """Numbers as text with separators, where the profile asks for them; percent text stays."""
    is_fraction = profile.change == "fraction"
    if not (is_fraction if profile.formatted is None else profile.formatted):
        return rows
    diff, relative = change_names(profile)
    shown = {name: format_integer(F.col(name)) for name in [*shown_columns(profile), diff]}
    if is_fraction:
        shown[relative] = format_percent(F.col(relative))
    return rows.withColumns(shown)


def label_columns(rows: DataFrame, profile: Profile, name: str) -> DataFrame:
    """Give columns their headings, which may differ between sections."""
    labels = profile.key_labels if name == "key" else profile.labels
    return rows.withColumnsRenamed(labels)


def section_table(comparison: DataFrame, profile: Profile, name: str) -> DataFrame:
    """One section as it is shown: titled, formatted, labelled, without the population column."""
    rows = drop_columns(section(comparison, name), "all_or_KP")
    titled = rows.select(
        F.lit(profile.title).alias("report"), F.lit(SUBTITLES[name]).alias("section"), "*"
    )
    return label_columns(format_numbers(titled, profile), profile, name)
