"""The comparison of next year's targets with earlier targets and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import (
    fiscal_label,
    not_in,
    percent_text,
    ratio,
    round_half_even,
    year_name,
)
from plumbline.operators import (
    absent_after_zero,
    bind_rows,
    derive,
    exclude_pairs,
    names_in,
    order_rows,
    pivot_wider,
    stored,
    sum_by,
)
from plumbline.plans.indicators import (
    DETAIL,
    TRIPLE,
    adjust_mapping,
    aggregate_plan,
    aggregate_plan_by_country,
    classify_population,
    match_sums,
    scoped_columns,
)
from plumbline.plans.profiles import Profile


def reported_sums(
    results: DataFrame,
    plan_columns: list[str],
    mapping: DataFrame,
    profile: Profile,
    resum: bool = True,
) -> DataFrame:
    """Scoped result sums per place, indicator, disaggregate and year.

    Raw names that become one final name are summed again, unless ``resum`` is false because a later
    step does so.

    Rows are summed by their raw names before the mapping is joined, which depends on those
    names alone. However large the results, the mapping or one key, the join sees the few sums.
    """
    rows = scoped_columns(results, plan_columns, profile)
    raw = sum_by(rows, [*profile.places, *TRIPLE, "fiscal_year"], profile.measures)
    matched = match_sums(raw, adjust_mapping(mapping), profile.supplement)
    keys = [*profile.places, *DETAIL]
    sums = sum_by(matched, keys, profile.measures) if resum else matched.select(*keys, *profile.measures)
    return refuse_year(sums, profile) if profile.shared_year == "error" else sums


def refuse_year(sums: DataFrame, profile: Profile) -> DataFrame:
    """Stop the query if the results hold the plan year.

    The check sits on a measure, so that filters on the year still reach the scan.
    """
    measure = profile.measures[0]
    message = F.raise_error(F.lit(f"the results already hold {profile.plan_year}"))
    in_plan_year = F.col("fiscal_year") == profile.plan_year
    return sums.withColumn(measure, F.when(in_plan_year, message).otherwise(F.col(measure)))


def planned_sums(plan: DataFrame, hierarchy: DataFrame | None, profile: Profile) -> DataFrame:
    """Plan sums of the profile's plan year, with the same keys."""
    if not profile.by_country:
        return aggregate_plan(plan, profile.plan_year)
    if hierarchy is None:
        raise ValueError("a report by country needs the site hierarchy")
    return aggregate_plan_by_country(plan, hierarchy, profile.plan_year, profile.operatingunit)


def combine(reported: DataFrame, planned: DataFrame, profile: Profile) -> DataFrame:
    """Both sides in one long table, without the profile's exclusions, with populations named."""
    indicator, disaggregate = F.col("indicator"), F.col("standardizeddisaggregate")
    kept = (
        bind_rows(reported, planned)
        .where(F.col("fiscal_year") >= profile.first_year)
        .where(exclude_pairs(indicator, disaggregate, profile.exclusions))
    )
    if profile.excluded_indicators:
        kept = kept.where(not_in(indicator, profile.excluded_indicators))
    return classify_population(kept)


def year_change(
    df: DataFrame, before: str, after: str, form: str, diff: str, relative: str
) -> DataFrame:
    """Add the difference and the relative change of two columns."""
    change = ratio(F.col(diff), F.col(before))
    if form == "fraction":
        rounded = round_half_even(change, 2)
    else:
        rounded = percent_text(round_half_even(change * 100))
    return derive(df, {diff: F.col(after) - F.col(before), relative: rounded})


def change_names(profile: Profile) -> tuple[str, str]:
    """Names of the difference and relative change columns."""
    if len(profile.measures) == 1:
        return "diff", "percent_change"
    before, after = (str(year)[2:] for year in profile.compared)
    measure = profile.measures[0]
    return f"{measure}_diff_fy_{after}_{before}", f"{measure}_percent_change_{after}_{before}"


def shown_columns(profile: Profile, names: Sequence[str] = ()) -> list[str]:
    """Year columns in display order: by year, and without results for the planned year.

    ``names`` are the labels of the years, if not those of the profile.
    """
    names = names or [year_name(year) for year in profile.years]
    if len(profile.measures) == 1:
        return list(names)
    return [
        f"{measure}_{name}"
        for name in names
        for measure in profile.measures
        if name != year_name(profile.plan_year) or measure == "targets"
    ]


def widen(combined: DataFrame, profile: Profile) -> DataFrame:
    """One row per id with the fiscal years as columns and the change between two of them.

    If every year becomes a column, the combined sums are stored and their years read from there.
    """
    names = [year_name(year) for year in profile.years]
    if profile.unlisted == "column":
        combined = stored(combined, "combined")
        label = combined.select(fiscal_label(F.col("fiscal_year")).alias("fiscal_year"))
        names = sorted({*names, *names_in(label, "fiscal_year")})
    wide = pivot_wider(
        combined.withColumn("fiscal_year", fiscal_label(F.col("fiscal_year"))),
        profile.ids,
        names_from="fiscal_year",
        names=names,
        measures=profile.measures,
        duplicates=profile.duplicates,
        unlisted="drop" if profile.unlisted == "drop" else "error",
    ).select(*profile.ids, *shown_columns(profile, names))
    prefix = "" if len(profile.measures) == 1 else f"{profile.measures[0]}_"
    before, after = (f"{prefix}{year_name(year)}" for year in profile.compared)
    if profile.drop_zero_and_absent:
        wide = wide.where(~absent_after_zero(F.col(before), F.col(after)))
    return year_change(wide, before, after, profile.change, *change_names(profile))


def compare(
    results: DataFrame,
    plan: DataFrame,
    mapping: DataFrame,
    profile: Profile,
    hierarchy: DataFrame | None = None,
) -> DataFrame:
    """The whole comparison for one profile, in display order.

    Nothing is computed yet, except the sums of a profile that gives every year a column.
    """
    # The pivot adds what meets in one cell where duplicates are summed.
    resum = profile.duplicates != "sum"
    reported = reported_sums(results, plan.columns, mapping, profile, resum)
    planned = planned_sums(plan, hierarchy, profile)
    return order_rows(widen(combine(reported, planned, profile), profile), *profile.ids)
