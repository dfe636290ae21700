"""Registered queries: each operator, and each whole comparison, over the star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import star
from plumbline import compare
from plumbline import functions as fx
from plumbline import operators as ops
from plumbline.operators.storage import shared_folder
from plumbline.plans import indicators, quality, report
from plumbline.plans.compare import combine, planned_sums, reported_sums, year_change
from plumbline.plans.indicators import DETAIL, SITE, TRIPLE
from plumbline.plans.profiles import CAREGIVERS, COUNTRY_REPORT_EXCLUSIONS, TB_STATUS
from plumbline.sources import fold_in, latest_file, read_summaries, read_with_quarantine
from plumbline.sources.tables import MAPPING, OPTIONAL, RESULTS, conform

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def unlocated(spark: SparkSession, sf: str) -> DataFrame:
    """All rows without sites: nothing is joined that the query does not use."""
    return star.fact(spark, sf, located=False)


def everything(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with their sites."""
    return star.fact(spark, sf).drop("c_mktsegment")


def all_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Every site, also those that the hierarchy does not list."""
    return star.sites(spark, sf).select(
        "operatingunit", F.col("country").alias("countryname"), "psnu", "psnuuid"
    )


def adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return indicators.adjust_mapping(star.mapping(spark, sf))


def comparison(spark: SparkSession, sf: str, profile) -> DataFrame:
    return compare(
        star.results(spark, sf),
        star.plan(spark, sf, profile),
        star.mapping(spark, sf),
        profile,
        star.hierarchy(spark, sf),
    )


def yearly(spark: SparkSession, sf: str) -> DataFrame:
    """Target sums per site, indicator and year: many numbers to round and format."""
    rows = star.fact(spark, sf)
    return ops.sum_by(rows, ["psnu", "indicator", "fiscal_year"], ["targets"]).withColumn(
        "fiscal_year", fx.fiscal_label(F.col("fiscal_year"))
    )


YEARS = [f"FY{year}" for year in range(21, 28)]


def yearly_wide(spark: SparkSession, sf: str) -> DataFrame:
    """All years side by side; another year would stop the query."""
    return ops.pivot_wider(
        yearly(spark, sf), ["psnu", "indicator"], "fiscal_year", YEARS, ["targets"]
    )


# Sources


@query
def newest_source(spark, sf):
    path = latest_file(spark, sf, r"^orders\.parquet$")
    orders = spark.read.schema(star.COLUMNS["orders"]).parquet(path)
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))


@query
def newest_of_several(spark, sf):
    """Three versions of the orders in one folder, of which the one written last is read."""
    folder = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    orders = star.table(spark, sf, "orders")
    for status in "FOP":
        part = orders.where(F.col("o_orderstatus") == status)
        part.write.parquet(f"{folder}/ORDERS_{status}.parquet")
    newest = spark.read.schema(star.COLUMNS["orders"]).parquet(latest_file(spark, folder, "^ORDERS"))
    return newest.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))


@query
def conform_types(spark, sf):
    """The numbers of results that come as text, in their declared types again."""
    rows = everything(spark, sf)
    as_text = {name: F.col(name).cast("string") for name in ("fiscal_year", "targets", "cumulative")}
    conformed = conform(rows.withColumns(as_text), RESULTS, OPTIONAL)
    return conformed.select(*_RESULT_COLUMNS)


_RESULT_COLUMNS = ["operatingunit", "country", *TRIPLE, "fiscal_year", "targets", "cumulative", "mech_code"]


@query
def damaged_lines(spark, sf):
    """Orders as lines of text, some short, long or with an open quote: what can be read and what not."""
    number, status = F.col("o_orderkey"), F.col("o_orderstatus")
    # Orders stand in for mapping rows: three texts to a line.
    fields = F.concat_ws("\t", F.col("o_orderpriority"), status, number.cast("string"))
    line = (
        F.when(status == "P", F.concat_ws("\t", F.col("o_orderpriority"), status))
        .when(number % 7 == 0, F.concat(fields, F.lit("\textra")))
        .when(number % 11 == 0, F.concat_ws("\t", F.concat(F.lit('"'), "o_orderpriority"), status, number))
        .when(number % 13 == 0, F.concat_ws("\t", F.col("o_orderpriority"), status, F.concat(F.lit('"'), number)))
        .otherwise(fields)
    )
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    written = star.table(spark, sf, "orders").select(line.alias("\t".join(MAPPING.fieldNames())))
    plain = written.write.option("header", True).option("sep", "\x01").option("quote", "")
    plain.option("ignoreTrailingWhiteSpace", False).csv(folder)
    good, bad = read_with_quarantine(spark, folder, "tsv", MAPPING)
    reasons = bad.select("reason", F.length("line").alias("size"))
    sizes = good.select(
        F.lit("none").alias("reason"),
        sum((F.length(c) for c in MAPPING.fieldNames()), F.lit(2)).alias("size"),
    )
    return (
        reasons.unionByName(sizes)
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("size").alias("n_chars"))
    )


# Projections


@query
def column_listing(spark, sf):
    plan = star.plan(spark, sf, star.CARIBBEAN)
    return everything(spark, sf).select(*[n for n in plan.columns if n != "cumulative"])


@query
def select_any_of(spark, sf):
    wanted = ["country", "sitename", "indicator", "country", "mech_code", "targets"]
    return ops.select_any_of(everything(spark, sf), wanted, must=indicators.MUST_EXIST)


@query
def strict_select(spark, sf):
    return all_sites(spark, sf).select("operatingunit", "countryname", "psnu", "psnuuid")


@query
def drop_columns(spark, sf):
    return ops.drop_columns(everything(spark, sf), "operatingunit", "cumulative")


@query
def rename(spark, sf):
    return ops.rename(all_sites(spark, sf), country="countryname", site="psnu")


@query
def relocate(spark, sf):
    return ops.relocate(yearly_wide(spark, sf), "FY27", after=2)


@query
def derive(spark, sf):
    return ops.derive(
        unlocated(spark, sf).select("mech_code", "indicator", "targets", "cumulative"),
        {
            "operatingunit": F.lit("Western Hemisphere Region"),
            "gap": F.col("targets") - F.col("cumulative"),
            "double_gap": F.col("gap") * 2,
        },
    )


@query
def unpivot_plan(spark, sf):
    wide = yearly_wide(spark, sf)
    return ops.unpivot_years(wide, {y: 2000 + int(y[2:]) for y in YEARS}, drop_missing=True)


# Filters


def _scoped(rows):
    return rows.select(
        "operatingunit", "country", "psnuuid", *TRIPLE, "fiscal_year", "targets", "cumulative"
    )


def _unscoped(rows):
    return rows.select(*TRIPLE, "fiscal_year", "targets", "mech_code", "source_name")


@query
def filter_scope(spark, sf):
    return _scoped(indicators.in_scope(everything(spark, sf), star.CARIBBEAN))


@query
def filter_year_text(spark, sf):
    return _unscoped(unlocated(spark, sf).where(ops.in_year(F.col("fiscal_year"), "2023")))


@query
def filter_year_range(spark, sf):
    rows = star.fact(spark, sf, located=False)
    return _unscoped(rows.where((F.col("fiscal_year") > 2022) & (F.col("fiscal_year") <= 2024)))


@query
def filter_membership(spark, sf):
    checked = F.col("indicator").isin(*quality.CHECKED_INDICATORS)
    return _unscoped(unlocated(spark, sf).where(checked))


@query
def filter_not_in_null_safe(spark, sf):
    rows = unlocated(spark, sf).where(fx.not_in(F.col("source_name"), ["Derived"]))
    return _unscoped(rows.where(fx.not_in(F.col("indicator"), TB_STATUS)))


@query
def exclude_pairs(spark, sf):
    rows = indicators.clean_indicator(unlocated(spark, sf))
    kept = ops.exclude_pairs(
        F.col("indicator"), F.col("standardizeddisaggregate"), COUNTRY_REPORT_EXCLUSIONS
    )
    return _unscoped(rows.where(kept))


@query
def guarded_exclusion(spark, sf):
    kept = ops.exclude_within(
        F.col("indicator"),
        "HTS_SELF",
        F.col("standardizeddisaggregate"),
        indicators.SELF_TEST_DISAGGREGATES,
    )
    return _unscoped(unlocated(spark, sf).where(kept))


@query
def substring_filter(spark, sf):
    age_and_sex = F.col("standardizeddisaggregate").contains("Age/Sex")
    return _unscoped(unlocated(spark, sf).where(age_and_sex))


@query
def zero_and_absent_filter(spark, sf):
    wide = yearly_wide(spark, sf)
    return wide.where(~ops.absent_after_zero(F.col("FY23"), F.col("FY24")))


# Joins


@query
def semi_join_mapping(spark, sf):
    listed = adjusted(spark, sf).distinct()
    return _unscoped(ops.lookup_join(unlocated(spark, sf), listed, TRIPLE, "left_semi"))


@query
def left_join_hierarchy(spark, sf):
    rows = star.marked(spark, sf)
    cleaned = fx.trim_whitespace(fx.remove_first(F.col("psnu"), "_Military"))
    lookup = ops.unique_lookup(star.hierarchy(spark, sf), SITE, "countryname")
    found = ops.lookup_join(rows.withColumn("psnu", cleaned), lookup, SITE)
    return found.select(*SITE, "countryname", *DETAIL, "targets")


@query
def left_join_totals(spark, sf):
    rows = unlocated(spark, sf)
    joined = ops.left_join(
        quality.disaggregate_sums(rows, source=None),
        quality.total_sums(rows, ["HTS_SELF", "PrEP_NEW"]),
        ["fiscal_year", "indicator"],
    )
    return joined.withColumn("difference", F.col("total_numerator") - F.col("age_sex_sum"))


# Sums


@query
def na_sum_one(spark, sf):
    return ops.sum_by(everything(spark, sf), ["country", *DETAIL], ["targets"])


@query
def na_sum_many(spark, sf):
    return ops.sum_by(unlocated(spark, sf), [*TRIPLE, "fiscal_year"], ["targets", "cumulative"])


@query
def resum_coarser(spark, sf):
    fine = ops.sum_by(unlocated(spark, sf), DETAIL, ["targets", "cumulative"])
    coarse = ["indicator", "fiscal_year", "all_or_KP"]
    return ops.sum_by(indicators.classify_population(fine), coarse, ["targets", "cumulative"])


@query
def distinct_hierarchy(spark, sf):
    return all_sites(spark, sf).select("operatingunit", "countryname").distinct()


# Unions


def _sums_of(spark, sf, kind, measures):
    rows = unlocated(spark, sf).where(F.col("numeratordenom") == kind)
    return ops.sum_by(rows, DETAIL, measures)


@query
def bind_rows_fill(spark, sf):
    return ops.bind_rows(
        _sums_of(spark, sf, "N", ["targets", "cumulative"]), _sums_of(spark, sf, "D", ["targets"])
    )


@query
def union_strict(spark, sf):
    both = ["targets", "cumulative"]
    return ops.union_strict(_sums_of(spark, sf, "N", both), _sums_of(spark, sf, "D", both))


# Reshaping


@query
def pivot_one(spark, sf):
    return yearly_wide(spark, sf)


@query
def pivot_two(spark, sf):
    rows = indicators.classify_population(unlocated(spark, sf)).withColumn(
        "fiscal_year", fx.fiscal_label(F.col("fiscal_year"))
    )
    return ops.pivot_wider(
        rows,
        ["indicator", "all_or_KP"],
        "fiscal_year",
        YEARS,
        ["targets", "cumulative"],
        duplicates="sum",
    )


@query
def pivot_unlisted(spark, sf):
    """Two of the seven years, the others dropped as asked."""
    return ops.pivot_wider(
        yearly(spark, sf),
        ["psnu", "indicator"],
        "fiscal_year",
        ["FY23", "FY24"],
        ["targets"],
        unlisted="drop",
    )


@query
def pivot_names_found(spark, sf):
    """The years are those that the sums have."""
    sums = yearly(spark, sf)
    return ops.pivot_wider(sums, ["psnu", "indicator"], "fiscal_year", None, ["targets"])


@query
def sort_nulls_last(spark, sf):
    sums = ops.sum_by(everything(spark, sf), ["country", *TRIPLE], ["targets"])
    return ops.order_rows(sums, "country", *TRIPLE)


# Scalar functions


@query
def case_when_without_default(spark, sf):
    rows = unlocated(spark, sf)
    missing, large = fx.is_missing(F.col("cumulative")), F.col("targets") > 25
    flagged = F.when(missing, "missing").when(large, "large")
    return rows.select("mech_code", "indicator", "targets", "cumulative", flagged.alias("size"))


@query
def fiscal_label(spark, sf):
    rows = star.years(spark, sf)
    label = fx.fiscal_label(F.col("fiscal_year")).alias("label")
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


@query
def replace_first_match(spark, sf):
    return all_sites(spark, sf).select(
        "psnuuid",
        fx.replace_first(F.col("psnu"), "0", "FY").alias("replaced"),
        fx.remove_first(F.col("psnu"), "00").alias("removed"),
    )


@query
def trim_site_names(spark, sf):
    sites = star.marked(spark, sf).select("psnuuid", "psnu").distinct()
    cleaned = fx.trim_whitespace(fx.remove_first(F.col("psnu"), "_Military"))
    return sites.select("psnuuid", F.length("psnu").alias("length"), cleaned.alias("cleaned"))


@query
def ieee_ratio(spark, sf):
    wide = yearly_wide(spark, sf).where(F.col("FY23").isNotNull() & F.col("FY24").isNotNull())
    change = fx.ratio(F.col("FY24") - F.col("FY23"), F.col("FY23"))
    return wide.select("psnu", "indicator", change.alias("change"))


@query
def rounded_ratio(spark, sf):
    wide = yearly_wide(spark, sf)
    share = fx.ratio(F.col("FY24"), F.lit(8.0))
    return wide.select(
        "psnu",
        "indicator",
        fx.round_half_even(share).alias("whole"),
        fx.round_half_even(share, 2).alias("two_digits"),
        fx.percent_text(fx.round_half_even(share)).alias("as_percent"),
    )


@query
def format_integer(spark, sf):
    wide = yearly_wide(spark, sf)
    larger = fx.format_integer(fx.drop_nan(F.col("FY24")) * 1234.5)
    return wide.select("psnu", "indicator", larger.alias("shown"))


@query
def format_percent(spark, sf):
    wide = yearly_wide(spark, sf)
    fraction = fx.round_half_even(fx.ratio(F.col("FY24") - F.col("FY23"), F.col("FY23")), 2)
    return wide.select("psnu", "indicator", fx.format_percent(fraction).alias("shown"))


# Domain steps


@query
def clean_indicator(spark, sf):
    return _unscoped(indicators.clean_indicator(unlocated(spark, sf)))


@query
def adjust_mapping(spark, sf):
    return adjusted(spark, sf)


@query
def harmonise_results(spark, sf):
    plan = star.plan(spark, sf, star.CARIBBEAN)
    mapping = star.mapping(spark, sf)
    results = star.results(spark, sf)
    return indicators.harmonise_results(results, mapping, plan.columns, star.CARIBBEAN)


@query
def supplement(spark, sf):
    scoped = indicators.in_scope(star.results(spark, sf), star.DOMINICAN_REPUBLIC)
    return indicators.supplement_rows(scoped, CAREGIVERS, ["targets", "cumulative"])


@query
def match_or_supplement(spark, sf):
    profile = star.DOMINICAN_REPUBLIC
    plan_columns = star.plan(spark, sf, profile).columns
    return reported_sums(star.results(spark, sf), plan_columns, star.mapping(spark, sf), profile)


@query
def aggregate_plan(spark, sf):
    return indicators.aggregate_plan(star.plan(spark, sf, star.CARIBBEAN), 2024)


@query
def assign_country(spark, sf):
    next_year = ops.in_year(F.col("fiscal_year"), 2024)
    plan = star.plan(spark, sf, star.CARIBBEAN).where(next_year)
    placed = indicators.assign_country(plan, star.hierarchy(spark, sf), "ASIA")
    return placed.select(*SITE, "country", *TRIPLE, "targets")


@query
def aggregate_plan_by_country(spark, sf):
    profile = star.CENTRAL_AMERICA_BY_COUNTRY
    return planned_sums(star.plan(spark, sf, profile), star.hierarchy(spark, sf), profile)


@query
def classify_population(spark, sf):
    classified = indicators.classify_population(unlocated(spark, sf))
    return classified.groupBy("standardizeddisaggregate", "all_or_KP").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def combined_sides(spark, sf):
    profile = star.CENTRAL_AMERICA
    plan = star.plan(spark, sf, profile)
    reported = reported_sums(
        star.results(spark, sf), plan.columns, star.mapping(spark, sf), profile
    )
    return combine(reported, planned_sums(plan, None, profile), profile)


@query
def year_change_fraction(spark, sf):
    return year_change(yearly_wide(spark, sf), "FY23", "FY24", "fraction", "diff", "change")


@query
def year_change_percent(spark, sf):
    return year_change(yearly_wide(spark, sf), "FY23", "FY24", "percent", "diff", "change")


@query
def year_change_other_years(spark, sf):
    wide = yearly_wide(spark, sf)
    return year_change(wide, "FY22", "FY24", "percent", "diff_fy_24_22", "percent_change_24_22")


@query
def indicator_total(spark, sf):
    rows = unlocated(spark, sf)
    return indicators.indicator_total(rows, "TX_CURR", "Age/Sex/HIVStatus", "2023")


@query
def indicator_total_of_plan(spark, sf):
    plan = star.marked(spark, sf)
    return indicators.indicator_total(plan, "HTS_TST", "Age/Sex", 2024, "targets")


# Checks


@query
def disagg_completeness(spark, sf):
    return quality.disagg_completeness(unlocated(spark, sf))


@query
def list_disaggregates(spark, sf):
    return quality.list_disaggregates(unlocated(spark, sf))


@query
def hierarchy_conflicts(spark, sf):
    segments = star.sites(spark, sf).select(
        "operatingunit",
        F.col("country").alias("countryname"),
        F.col("c_mktsegment").alias("psnu"),
        F.substring("psnuuid", -2, 2).alias("psnuuid"),
    )
    return quality.hierarchy_conflicts(segments)


@query
def shared_years(spark, sf):
    rows = star.years(spark, sf)
    year = F.col("fiscal_year")
    return quality.shared_years(rows.where(year <= 2024), rows.where(year >= 2023))


@query
def absent_years(spark, sf):
    profile = replace(star.CARIBBEAN, years=(2015, 2023, 2024))
    return quality.absent_years(star.results(spark, sf), star.plan(spark, sf, profile), profile)


@query
def unlisted_years(spark, sf):
    profile = replace(star.CARIBBEAN, years=(2021, 2023))
    return quality.unlisted_years(star.results(spark, sf), star.plan(spark, sf, profile), profile)


@query
def unmatched_sites(spark, sf):
    plan = star.plan(spark, sf, star.CARIBBEAN)
    return quality.unmatched_sites(plan, star.hierarchy(spark, sf), 2024, "ASIA")


# Comparisons


@query
def compare_dr(spark, sf):
    return comparison(spark, sf, star.DOMINICAN_REPUBLIC)


@query
def compare_caribbean(spark, sf):
    return comparison(spark, sf, star.CARIBBEAN)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Results summed as files came: years up to 2022 first, 2023 in another file, nothing read twice."""
    folder = f"{shared_folder(spark)}/growing-{uuid.uuid4().hex}"
    rows = star.results(spark, sf)
    store = f"{folder}-sums"
    for mode, part in (("error", rows.where("fiscal_year < 2023")), ("append", rows.where("fiscal_year = 2023"))):
        part.write.mode(mode).parquet(folder)
        fold_in(spark, store, [folder])
    return read_summaries(spark, store)


@query
def compare_caribbean_from_sums(spark, sf):
    plan = star.plan(spark, sf, star.CARIBBEAN)
    return compare(_summaries(spark, sf), plan, star.mapping(spark, sf), star.CARIBBEAN)


@query
def completeness_from_sums(spark, sf):
    return quality.disagg_completeness(_summaries(spark, sf))


@query
def compare_caribbean_all_years(spark, sf):
    """A regional report over the rows of all years, each of which gets a column; 2024 is planned."""
    profile = replace(star.CARIBBEAN, unlisted="column", years=(2022, 2023))
    results = everything(spark, sf).where(F.col("fiscal_year") != profile.plan_year)
    plan = star.plan(spark, sf, profile)
    return compare(results, plan, star.mapping(spark, sf), profile)


@query
def compare_caribbean_by_country(spark, sf):
    return comparison(spark, sf, star.CARIBBEAN_BY_COUNTRY)


@query
def compare_central_america(spark, sf):
    return comparison(spark, sf, star.CENTRAL_AMERICA)


@query
def compare_central_america_by_country(spark, sf):
    return comparison(spark, sf, star.CENTRAL_AMERICA_BY_COUNTRY)


# Reports


@query
def section_all(spark, sf):
    return report.section(comparison(spark, sf, star.CARIBBEAN), "all")


@query
def section_key(spark, sf):
    return report.section(comparison(spark, sf, star.CARIBBEAN), "key")


@query
def both_sections(spark, sf):
    return report.both_sections(comparison(spark, sf, star.CARIBBEAN_BY_COUNTRY))


@query
def report_table_all(spark, sf):
    profile = star.DOMINICAN_REPUBLIC
    return report.section_table(comparison(spark, sf, profile), profile, "all")


@query
def report_table_key(spark, sf):
    profile = star.DOMINICAN_REPUBLIC
    return report.section_table(comparison(spark, sf, profile), profile, "key")


@query
def report_table_percent_text(spark, sf):
    """The country report with its integer formats and the change as whole percent."""
    profile = replace(star.DOMINICAN_REPUBLIC, change="percent", formatted=True)
    return report.section_table(comparison(spark, sf, profile), profile, "all")


@query
def report_table_by_country(spark, sf):
    profile = star.CENTRAL_AMERICA_BY_COUNTRY
    return report.section_table(comparison(spark, sf, profile), profile, "all")
