"""Checks of the inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import derive, in_year, left_join, order_rows, rename, sum_by
from plumbline.plans.indicators import DETAIL, SITE, clean_site, in_scope, plan_targets
from plumbline.plans.profiles import Profile

# Names in the results table.
CHECKED_INDICATORS = ("HTS_SELF", "PrEP_NEW", "GEND_GBV", "OVC_SERV")
TOTAL = "Total Numerator"
AGE_AND_SEX = "Age/Sex"
SOURCE = "DATIM"


def _from_source(source: str | None) -> Column:
    return F.lit(True) if source is None else F.col("source_name") == source


def disaggregate_sums(
    results: DataFrame,
    indicators: Sequence[str] = CHECKED_INDICATORS,
    contains: str = AGE_AND_SEX,
    source: str | None = SOURCE,
) -> DataFrame:
    """Target sums of each matching disaggregate from one source (all sources if ``None``)."""
    rows = results.where(
        F.col("indicator").isin(*indicators) & F.col("standardizeddisaggregate").contains(contains)
    ).where(_from_source(source))
    sums = sum_by(rows, ["fiscal_year", "indicator", "standardizeddisaggregate"], ["targets"])
    return rename(sums, age_sex_sum="targets")


def total_sums(
    results: DataFrame, indicators: Sequence[str] = CHECKED_INDICATORS, total: str = TOTAL
) -> DataFrame:
    """Target sums of the total rows, from all sources."""
    rows = results.where(
        F.col("indicator").isin(*indicators) & (F.col("standardizeddisaggregate") == total)
    )
    sums = sum_by(rows, ["fiscal_year", "indicator"], ["targets"])
    return rename(sums, total_numerator="targets")


def disagg_completeness(
    results: DataFrame,
    indicators: Sequence[str] = CHECKED_INDICATORS,
    total: str = TOTAL,
    contains: str = AGE_AND_SEX,
    source: str | None = SOURCE,
    total_source: str | None = None,
) -> DataFrame:
    """Total numerator minus each Age/Sex disaggregate's sum; a source of ``None`` is every source.

    The same as joining :func:`disaggregate_sums` to :func:`total_sums`, but both come from
    one pass over the results, and a window over the few sums puts them side by side.
    """
    if contains in total:
        raise ValueError("the total must not itself count as a disaggregate")
    disaggregate = F.col("standardizeddisaggregate")
    is_total = disaggregate == total
    wanted = (is_total & _from_source(total_source)) | (
        disaggregate.contains(contains) & _from_source(source)
    )
    rows = results.where(F.col("indicator").isin(*indicators) & wanted)
    sums = sum_by(rows, DETAIL, ["targets"])
    same_indicator = Window.partitionBy("fiscal_year", "indicator")
    side_by_side = derive(
        sums,
        {
            "total_numerator": F.sum(F.when(is_total, F.col("targets"))).over(same_indicator),
            "difference": F.col("total_numerator") - F.col("targets"),
        },
    ).where(~is_total)
    keys = ["fiscal_year", "indicator", "standardizeddisaggregate"]
    columns = [*keys, "age_sex_sum", "total_numerator", "difference"]
    return order_rows(rename(side_by_side, age_sex_sum="targets").select(*columns), *keys)


def list_disaggregates(
    results: DataFrame,
    indicators: Sequence[str] = CHECKED_INDICATORS,
    contains: str = AGE_AND_SEX,
    source: str | None = SOURCE,
) -> DataFrame:
    """The matching disaggregates in use per year and indicator."""
    keys = ["fiscal_year", "indicator", "standardizeddisaggregate"]
    return order_rows(disaggregate_sums(results, indicators, contains, source).select(*keys), *keys)


def hierarchy_conflicts(hierarchy: DataFrame) -> DataFrame:
    """Sites listed under more than one country, which would multiply plan rows."""
    name = F.col("countryname")
    return (
        hierarchy.select(*SITE, name)
        .distinct()
        .groupBy(*SITE)
        .agg(
            F.count(F.lit(1)).alias("names"),
            F.min(name).alias("first_name"),
            F.max(name).alias("last_name"),
        )
        .where(F.col("names") > 1)
    )


def shared_years(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Years in both tables; the plan year there would be counted twice or stop the pivot."""
    planned = plan.select("fiscal_year").distinct()
    return results.select("fiscal_year").distinct().join(planned, "fiscal_year", "left_semi")


def absent_years(results: DataFrame, plan: DataFrame, profile: Profile) -> DataFrame:
    """Years of a profile for which neither side has a row in scope, before mapping and exclusions."""
    reported = in_scope(results, profile).select("fiscal_year")
    planned = plan.where(in_year(F.col("fiscal_year"), profile.plan_year)).select("fiscal_year")
    years = [(year,) for year in profile.years]
    wanted = results.sparkSession.createDataFrame(years, "fiscal_year INT")
    return wanted.join(reported.union(planned).distinct(), "fiscal_year", "left_anti")


def unlisted_years(results: DataFrame, plan: DataFrame, profile: Profile) -> DataFrame:
    """Years from the profile's first on that its scope holds and its report has no column for."""
    years = in_scope(results, profile).select("fiscal_year").unionByName(
        plan.where(in_year(F.col("fiscal_year"), profile.plan_year)).select("fiscal_year")
    )
    year = F.col("fiscal_year")
    return years.where((year >= profile.first_year) & ~year.isin(*profile.years)).distinct()


def unmatched_sites(
    plan: DataFrame, hierarchy: DataFrame, year: int, operatingunit: str
) -> DataFrame:
    """Plan sites the hierarchy does not know, which become countries of their own."""
    raw = sum_by(plan_targets(plan, year), ["psnu", "psnuuid"], ["targets"])
    sites = sum_by(clean_site(raw, operatingunit), SITE, ["targets"])
    known = hierarchy.select(*SITE, "countryname").distinct()
    return left_join(sites, known, SITE).where(F.col("countryname").isNull()).drop("countryname")
