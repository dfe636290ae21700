"""Steps that bring results and plan to the same indicators, disaggregates and places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import remove_first, trim_whitespace
from plumbline.operators import (
    derive,
    drop_columns,
    exclude_within,
    in_year,
    left_join,
    lookup_join,
    select_any_of,
    sum_by,
    unique_lookup,
)
from plumbline.plans.profiles import Profile, Supplement

TRIPLE = ("indicator", "numeratordenom", "standardizeddisaggregate")
DETAIL = ("indicator", "standardizeddisaggregate", "fiscal_year")
SITE = ("operatingunit", "psnu", "psnuuid")
MUST_EXIST = ("funding_agency", "mech_code")

# Names the mapping and the results spell differently.
SELF_TEST_DISAGGREGATES = ("Age/Sex/HIVSelfTest", "KeyPop/HIVSelfTest")
PLAN_KEY_POPULATION, RESULT_KEY_POPULATION = "KeyPop", "KeyPopAbr"


def clean_indicator(df: DataFrame) -> DataFrame:
    """Append ``_D`` to the indicator of denominator rows."""
    indicator = F.col("indicator")
    denominator = F.concat(indicator, F.lit("_D"))
    return df.withColumn(
        "indicator", F.when(F.col("numeratordenom") == "D", denominator).otherwise(indicator)
    )


def _renamed_prep(old: str, new: str) -> Column:
    disaggregate = F.col("standardizeddisaggregate")
    is_prep = (F.col("indicator") == "PrEP_NEW") & (disaggregate == old)
    return F.when(is_prep, F.lit(new)).otherwise(disaggregate)


def adjust_mapping(mapping: DataFrame) -> DataFrame:
    """Use the results' name for PrEP_NEW key populations and drop the self-test rows."""
    prep = _renamed_prep(PLAN_KEY_POPULATION, RESULT_KEY_POPULATION)
    return mapping.withColumn("standardizeddisaggregate", prep).where(
        exclude_within(
            F.col("indicator"),
            "HTS_SELF",
            F.col("standardizeddisaggregate"),
            SELF_TEST_DISAGGREGATES,
        )
    )


def restore_prep(df: DataFrame) -> DataFrame:
    """Give PrEP_NEW key populations their plan name again."""
    prep = _renamed_prep(RESULT_KEY_POPULATION, PLAN_KEY_POPULATION)
    return df.withColumn("standardizeddisaggregate", prep)


def in_scope(results: DataFrame, profile: Profile) -> DataFrame:
    """Result rows of the profile's operating unit and countries."""
    rows = results.where(F.col("operatingunit") == profile.operatingunit)
    return rows.where(F.col("country").isin(*profile.countries)) if profile.countries else rows


def scoped_columns(results: DataFrame, plan_columns: Sequence[str], profile: Profile) -> DataFrame:
    """Scope filter, then the plan's columns that exist plus two that must."""
    return select_any_of(in_scope(results, profile), plan_columns, must=MUST_EXIST)


def harmonise_results(
    results: DataFrame, mapping: DataFrame, plan_columns: Sequence[str], profile: Profile
) -> DataFrame:
    """Site-level result rows in scope that the mapping lists, named as in the plan.

    The mapping is matched by raw names; only then do rows get their final ones.
    """
    rows = scoped_columns(results, plan_columns, profile)
    listed = lookup_join(rows, adjust_mapping(mapping).distinct(), TRIPLE, "left_semi")
    return restore_prep(clean_indicator(listed))


def _is_supplement(supplement: Supplement) -> Column:
    return (
        (F.col("indicator") == supplement.indicator)
        & (F.col("standardizeddisaggregate") == supplement.standardizeddisaggregate)
        & (F.col("fiscal_year") >= supplement.first_year)
    )


def supplement_rows(rows: DataFrame, supplement: Supplement, measures: Sequence[str]) -> DataFrame:
    """Sums of scoped result rows that enter a report without passing the mapping."""
    return sum_by(clean_indicator(rows.where(_is_supplement(supplement))), DETAIL, measures)


def match_sums(
    sums: DataFrame, adjusted: DataFrame, supplement: Supplement | None = None
) -> DataFrame:
    """Sums by raw names that the mapping lists, and those of the supplement, with final names.

    A sum that is both comes out twice, as a union of the two would give, but a union would read the
    results a second time. The mapping joins as a flag and not as a semi join: that, Spark would
    move below the sums if the mapping is small, and probing it per row costs more than summing.
    """
    listed = adjusted.select(*TRIPLE).distinct().withColumn("listed", F.lit(True))
    flagged = left_join(sums, listed, TRIPLE)
    if supplement is None:
        return restore_prep(clean_indicator(flagged.where("listed").drop("listed")))
    routes = F.array_compact(
        F.array(
            F.when(F.col("listed"), F.lit("mapping")),
            F.when(_is_supplement(supplement), F.lit("supplement")),
        )
    )
    cleaned = clean_indicator(flagged.withColumn("route", F.explode(routes)).drop("listed"))
    restored = F.when(
        F.col("route") == "mapping", _renamed_prep(RESULT_KEY_POPULATION, PLAN_KEY_POPULATION)
    ).otherwise(F.col("standardizeddisaggregate"))
    return cleaned.withColumn("standardizeddisaggregate", restored).drop("route")


def plan_targets(plan: DataFrame, year: int) -> DataFrame:
    """Plan rows of one year with cleaned indicators."""
    return clean_indicator(plan).where(in_year(F.col("fiscal_year"), year))


def aggregate_plan(plan: DataFrame, year: int, places: Sequence[str] = ()) -> DataFrame:
    """Planned targets of one year per indicator and disaggregate, and per place if given."""
    rows = drop_columns(plan_targets(plan, year), "operatingunit")
    return sum_by(rows, [*places, *DETAIL], ["targets"])


def clean_site(plan: DataFrame, operatingunit: str) -> DataFrame:
    """Set the operating unit and take the military mark and outer whitespace off site names."""
    return derive(
        plan,
        {
            "operatingunit": F.lit(operatingunit),
            "psnu": trim_whitespace(remove_first(F.col("psnu"), "_Military")),
        },
    )


def site_countries(hierarchy: DataFrame, operatingunit: str, duplicates: str = "error") -> DataFrame:
    """The country of each site of one operating unit."""
    sites = hierarchy.where(F.col("operatingunit") == operatingunit).select(*SITE, "countryname")
    return unique_lookup(sites, SITE, "countryname", duplicates)


def _with_country(located: DataFrame) -> DataFrame:
    country = F.coalesce(F.col("countryname"), F.col("psnu"))
    return located.withColumn("country", country).drop("countryname")


def assign_country(
    plan: DataFrame, hierarchy: DataFrame, operatingunit: str, duplicates: str = "error"
) -> DataFrame:
    """Replace a plan row's country by its site's; an unknown site becomes its own country."""
    lookup = site_countries(hierarchy, operatingunit, duplicates)
    return _with_country(lookup_join(clean_site(plan, operatingunit), lookup, SITE))


def aggregate_plan_by_country(
    plan: DataFrame, hierarchy: DataFrame, year: int, operatingunit: str
) -> DataFrame:
    """Planned targets of one year per country, indicator and disaggregate.

    Rows are summed per raw site name, located, and summed again per country. A site that holds much of
    the plan leaves each task as one row per indicator and disaggregate, and joins as that many.
    """
    raw = sum_by(plan_targets(plan, year), ["psnu", "psnuuid", *DETAIL], ["targets"])
    lookup = site_countries(hierarchy, operatingunit)
    located = _with_country(left_join(clean_site(raw, operatingunit), lookup, SITE))
    return sum_by(located, ["country", *DETAIL], ["targets"])


def classify_population(df: DataFrame) -> DataFrame:
    """Add ``all_or_KP``; a missing disaggregate counts as key population."""
    is_general = ~F.col("standardizeddisaggregate").contains("Key")
    return df.withColumn("all_or_KP", F.when(is_general, "Age/Sex").otherwise("KeyPop"))


def indicator_total(
    rows: DataFrame, indicator: str, disaggregate: str, year: int | str, measure: str = "cumulative"
) -> DataFrame:
    """One measure's total for an indicator, disaggregate and year, over all operating units."""
    wanted = rows.where(
        (F.col("indicator") == indicator) & (F.col("standardizeddisaggregate") == disaggregate)
    ).where(in_year(F.col("fiscal_year"), year))
    return sum_by(wanted, DETAIL, [measure])
