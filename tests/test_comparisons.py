"""Whole comparisons and checks on small tables with known answers."""

import math
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import fixtures
from plumbline import PROFILES, Profile, compare
from plumbline.operators import pivot_wider, unpivot_years
from plumbline.plans import indicators, quality, report

ISLANDS, MODALITY = fixtures.ISLANDS, fixtures.MODALITY


def rows(df):
    return [tuple(row) for row in df.collect()]


@pytest.fixture(scope="module")
def country(spark):
    return compare(
        fixtures.country_results(spark),
        fixtures.country_plan(spark),
        fixtures.mapping(spark),
        PROFILES["dominican_republic"],
    )


def regional(spark, profile, *extra_results, extra_sites=()):
    return compare(
        fixtures.regional_results(spark, *extra_results),
        fixtures.regional_plan(spark),
        fixtures.mapping(spark),
        profile,
        fixtures.hierarchy(spark, *extra_sites),
    )


COUNTRY_ROWS = [
    ("HTS_TST", "Age/Sex", 100.0, 90.0, 150.0, 10.0, 165.0, 15.0, 0.1),
    ("KP_PREV", "KeyPop", None, None, 0.0, 3.0, 5.0, 5.0, math.inf),
    ("OVC_SERV", "Age/Sex", None, None, 17.0, 7.0, 20.0, 3.0, 0.18),
    ("PMTCT_STAT", "Age/Sex", None, None, None, None, 6.0, None, None),
    ("TX_NEW", "Age/Sex", None, None, 20.0, 20.0, None, None, None),
    ("TX_PVLS_D", "Age/Sex", None, None, 40.0, 20.0, 45.0, 5.0, 0.12),
]


def test_country_report(country):
    assert country.columns == [
        "indicator",
        "all_or_KP",
        "targets_FY22",
        "cumulative_FY22",
        "targets_FY23",
        "cumulative_FY23",
        "targets_FY24",
        "targets_diff_fy_24_23",
        "targets_percent_change_24_23",
    ]
    assert rows(country) == COUNTRY_ROWS


def test_country_report_counts_a_listed_supplement_twice(spark):
    caregivers = ("OVC_SERV", "N", "Age/Sex/ProgramStatusCaregiver")
    extra = spark.createDataFrame([caregivers], fixtures.MAPPING)
    listed = compare(
        fixtures.country_results(spark),
        fixtures.country_plan(spark),
        fixtures.mapping(spark).union(extra),
        PROFILES["dominican_republic"],
    )
    assert listed.where(F.col("indicator") == "OVC_SERV").first().targets_FY23 == 24.0


def test_supplement_equals_its_own_query(spark):
    profile = PROFILES["dominican_republic"]
    scoped = indicators.in_scope(fixtures.country_results(spark), profile)
    found = indicators.supplement_rows(scoped, profile.supplement, profile.measures)
    assert rows(found) == [("OVC_SERV", "Age/Sex/ProgramStatusCaregiver", 2023, 7.0, 7.0)]


def test_by_country_report(spark):
    assert rows(regional(spark, PROFILES["caribbean_by_country"])) == [
        ("Jamaica", "HTS_TST", "Age/Sex", 200.0, 160.0, -40.0, "-20%"),
        ("Jamaica", "KP_PREV", "KeyPop", 0.0, 0.0, 0.0, None),
        ("Jamaica", "PrEP_NEW", "KeyPop", 8.0, 12.0, 4.0, "50%"),
        (ISLANDS, "HTS_TST", "Age/Sex", 40.0, 41.0, 1.0, "2%"),
    ]


REGIONAL_ROWS = [
    ("HTS_TST", "Age/Sex", 240.0, 201.0, -39.0, "-16%"),
    ("KP_PREV", "KeyPop", 0.0, 0.0, 0.0, None),
    ("PrEP_NEW", "KeyPop", 8.0, 12.0, 4.0, "50%"),
]


def test_regional_report(spark):
    df = regional(spark, PROFILES["caribbean"])
    assert df.columns == ["indicator", "all_or_KP", "FY23", "FY24", "diff", "percent_change"]
    assert rows(df) == REGIONAL_ROWS


def test_central_rules_keep_zero_and_absent_rows(spark):
    zero = ("VMMC_CIRC", "Age/Sex", 0.0, None, None, None)
    assert rows(regional(spark, fixtures.central_profile(False))) == [*REGIONAL_ROWS, zero]
    by_country = rows(regional(spark, fixtures.central_profile(True)))
    assert ("Jamaica", *zero) in by_country and len(by_country) == 5


def test_central_rules_drop_tuberculosis_status(spark):
    extra = [("Jamaica", "TB_STAT", "Age/Sex", 5.0)]
    mapping = fixtures.mapping(spark).union(
        spark.createDataFrame([("TB_STAT", "N", "Age/Sex")], fixtures.MAPPING)
    )
    for name, expected in (("caribbean", True), ("central_america", False)):
        profile = replace(PROFILES[name], countries=PROFILES["caribbean"].countries)
        results = fixtures.regional_results(spark, *extra)
        df = compare(results, fixtures.regional_plan(spark), mapping, profile)
        assert ("TB_STAT" in [row.indicator for row in df.collect()]) == expected


def test_second_disaggregate_stops_a_regional_report(spark):
    mapping = fixtures.mapping(spark).union(
        spark.createDataFrame([("HTS_TST", "N", "Age/Sex")], fixtures.MAPPING)
    )
    results = fixtures.regional_results(spark, ("Jamaica", "HTS_TST", "Age/Sex", 1.0))
    df = compare(results, fixtures.regional_plan(spark), mapping, PROFILES["caribbean"])
    with pytest.raises(PySparkException, match="more than one targets in FY23 for HTS_TST"):
        df.collect()


def test_site_in_two_countries_stops_the_by_country_report(spark):
    twice = (fixtures.REGION, "Haiti", "Kingston", "k1")
    with pytest.raises(PySparkException, match="more than one countryname"):
        regional(spark, PROFILES["caribbean_by_country"], extra_sites=[twice]).collect()
    elsewhere = [("Elsewhere", name, "Kingston", "k1") for name in ("A", "B")]
    df = regional(spark, PROFILES["caribbean_by_country"], extra_sites=elsewhere)
    assert df.count() == 4


def test_by_country_report_needs_a_hierarchy(spark):
    with pytest.raises(ValueError, match="hierarchy"):
        compare(
            fixtures.regional_results(spark),
            fixtures.regional_plan(spark),
            fixtures.mapping(spark),
            PROFILES["caribbean_by_country"],
        )


def test_plan_year_in_the_results(spark):
    again = fixtures.regional_results(spark).withColumn("fiscal_year", F.lit(2024))
    results = fixtures.regional_results(spark).union(again)
    shared = quality.shared_years(results, fixtures.regional_plan(spark))
    assert rows(shared) == [(2024,)]
    tables = (results, fixtures.regional_plan(spark), fixtures.mapping(spark))
    with pytest.raises(PySparkException, match="already hold 2024"):
        compare(*tables, replace(PROFILES["caribbean"], shared_year="error")).collect()
    doubled = replace(PROFILES["caribbean"], duplicates="sum")
    assert rows(compare(*tables, doubled))[0][:4] == ("HTS_TST", "Age/Sex", 240.0, 441.0)


def test_years_without_rows(spark):
    profile = replace(PROFILES["caribbean"], years=(2022, 2023, 2024))
    tables = (fixtures.regional_results(spark), fixtures.regional_plan(spark))
    assert rows(quality.absent_years(*tables, profile)) == [(2022,)]
    report = compare(*tables, fixtures.mapping(spark), profile)
    assert report.where(F.col("FY22").isNotNull()).count() == 0


def test_results_without_the_mandatory_columns(spark):
    results = fixtures.regional_results(spark).drop("mech_code")
    with pytest.raises(ValueError, match="missing columns: mech_code"):
        compare(
            results, fixtures.regional_plan(spark), fixtures.mapping(spark), PROFILES["caribbean"]
        )


def test_missing_numeratordenom_matches_and_keeps_the_name(spark):
    mapping = spark.createDataFrame([("A", None, "Age/Sex")], fixtures.MAPPING)
    made = [
        fixtures.result(fixtures.REGION, "Jamaica", "A", kind, "Age/Sex", 2023, 2.0)
        for kind in (None, "N")
    ]
    results = spark.createDataFrame(made, fixtures.RESULTS)
    df = compare(results, fixtures.regional_plan(spark), mapping, PROFILES["caribbean"])
    assert ("A", "Age/Sex", 2.0, None, None, None) in rows(df)


def test_harmonised_rows_keep_raw_name_order(spark):
    """Denominators get their name before key populations do, so theirs stays abbreviated."""
    mapping = spark.createDataFrame([("PrEP_NEW", "D", "KeyPop")], fixtures.MAPPING)
    made = fixtures.result(fixtures.REGION, "Jamaica", "PrEP_NEW", "D", "KeyPopAbr", 2023, 2.0)
    df = indicators.harmonise_results(
        spark.createDataFrame([made], fixtures.RESULTS),
        mapping,
        fixtures.regional_plan(spark).columns,
        PROFILES["caribbean"],
    )
    row = df.first()
    assert (row.indicator, row.standardizeddisaggregate) == ("PrEP_NEW_D", "KeyPopAbr")
    assert "source_name" not in df.columns and df.columns[-2:] == ["funding_agency", "mech_code"]


def test_missing_disaggregate_is_key_population(spark):
    df = spark.createDataFrame(
        [("Age/Sex",), ("KeyPop/Result",), ("Total Numerator",), (None,)],
        "standardizeddisaggregate STRING",
    )
    found = [row.all_or_KP for row in indicators.classify_population(df).collect()]
    assert found == ["Age/Sex", "KeyPop", "Age/Sex", "KeyPop"]


def test_unknown_site_is_its_own_country(spark):
    plan = fixtures.regional_plan(spark)
    sites = fixtures.hierarchy(spark)
    placed = indicators.assign_country(plan, sites, fixtures.REGION)
    assert {(row.psnu, row.country) for row in placed.collect()} == {
        ("Kingston", "Jamaica"),
        ("Jamaica", "Jamaica"),
        ("Port of Spain", ISLANDS),
    }
    unknown = quality.unmatched_sites(plan, sites, 2024, fixtures.REGION)
    assert rows(unknown) == [(fixtures.REGION, "Jamaica", "jm", 10.0)]


def test_hierarchy_conflicts(spark):
    twice = (fixtures.REGION, None, "Kingston", "k1")
    assert rows(quality.hierarchy_conflicts(fixtures.hierarchy(spark, twice))) == [
        (fixtures.REGION, "Kingston", "k1", 2, "Jamaica", "Jamaica")
    ]
    assert rows(quality.hierarchy_conflicts(fixtures.hierarchy(spark))) == []


def test_completeness(spark):
    results = fixtures.completeness_results(spark)
    expected = [
        (2023, "GEND_GBV", "Age/Sex/ViolenceType", 12.0, None, None),
        (2023, "HTS_SELF", "4:Age/Sex", 90.0, 105.0, 15.0),
        (2023, "HTS_SELF", "Age/Sex/HIVSelfTest", 60.0, 105.0, 45.0),
        (2023, "PrEP_NEW", "Age/Sex", 0.0, 9.0, 9.0),
    ]
    assert rows(quality.disagg_completeness(results)) == expected
    assert rows(quality.list_disaggregates(results)) == [row[:3] for row in expected]
    every_source = quality.disagg_completeness(results, source=None, total_source="DATIM")
    self_tests = every_source.where(F.col("indicator") == "HTS_SELF")
    assert [row[3:] for row in rows(self_tests)] == [
        (90.0, 100.0, 10.0),
        (1.0, 100.0, 99.0),
        (60.0, 100.0, 40.0),
    ]
    with pytest.raises(ValueError, match="total"):
        quality.disagg_completeness(results, total="Age/Sex total")


def test_indicator_total_takes_all_operating_units(spark):
    results = fixtures.country_results(spark)
    found = indicators.indicator_total(results, "HTS_TST", MODALITY, "2023", "targets")
    assert rows(found) == [("HTS_TST", MODALITY, 2023, 1149.0)]


def test_sections_share_only_kp_prev(country):
    everyone = {row.indicator for row in report.section(country, "all").collect()}
    key = {row.indicator for row in report.section(country, "key").collect()}
    assert len(everyone) == 6 and key == {"KP_PREV"}
    both = report.both_sections(country)
    assert both.count() == 7 and both.where(F.col("section") == "key").count() == 1
    with pytest.raises(ValueError, match="unknown section"):
        report.section(country, "none")


def test_country_tables(country):
    profile = PROFILES["dominican_republic"]
    everyone = report.section_table(country, profile, "all")
    assert everyone.columns == [
        "report",
        "section",
        "indicator",
        "targets_FY22",
        "results_FY22",
        "targets_FY23",
        "results_FY23",
        "targets_FY24",
        "targets change_FY24_23",
        "targets % change FY24_FY23",
    ]
    assert rows(everyone)[1] == (
        "Dominican Republic Target Summary",
        "All Populations",
        "KP_PREV",
        None,
        None,
        "0",
        "3",
        "5",
        "5",
        "Inf%",
    )
    assert rows(everyone)[0][-2:] == ("15", "10%")
    key = report.section_table(country, profile, "key")
    assert key.columns[-1] == "targets % change FY24-FY23"
    assert [row.section for row in key.collect()] == ["Key Populations"]


def test_regional_table_keeps_numbers(spark):
    profile = PROFILES["caribbean"]
    table = report.section_table(regional(spark, profile), profile, "key")
    assert table.columns[2:] == ["indicator", "FY23", "FY24", "change", "% change"]
    assert rows(table)[1][2:] == ("PrEP_NEW", 8.0, 12.0, 4.0, "50%")


def test_profile_settings_are_checked():
    for wrong in (
        {"duplicates": "first"},
        {"change": "ratio"},
        {"years": (2024, 2023)},
        {"years": (2024,)},
        {"shared_year": "drop"},
        {"by_country": True, "measures": ("targets", "cumulative")},
    ):
        with pytest.raises(ValueError):
            Profile("title", "unit", **wrong)


def test_pivot_and_unpivot_keep_the_sum(spark):
    results = fixtures.country_results(spark).withColumn(
        "label", F.concat(F.lit("FY"), F.col("fiscal_year").cast("string"))
    )
    wide = pivot_wider(
        results, ["indicator"], "label", ["FY2022", "FY2023"], ["targets"], duplicates="sum"
    )
    long = unpivot_years(wide, {"FY2022": 2022, "FY2023": 2023})
    total = F.sum("targets").alias("total")
    assert long.agg(total).first() == results.agg(total).first()


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_order_and_partitioning_of_the_input_do_not_matter(spark, partitions):
    def mixed(df):
        return df.orderBy(F.rand(partitions)).repartition(partitions)

    df = compare(
        mixed(fixtures.country_results(spark)),
        mixed(fixtures.country_plan(spark)),
        mixed(fixtures.mapping(spark)),
        PROFILES["dominican_republic"],
    )
    assert rows(df) == COUNTRY_ROWS


def test_a_hot_key_holding_most_rows(spark):
    """A third of the rows and more in one triple sum to the same as a few rows would."""
    base = fixtures.regional_results(spark)
    hot = base.where(F.col("country") == "Jamaica").where(F.col("indicator") == "HTS_TST")
    copies = F.explode(F.sequence(F.lit(1), F.lit(50_000))).alias("copy")
    many = hot.select("*", copies).drop("copy").withColumn("targets", F.lit(1.0)).repartition(16)
    df = compare(
        base.union(many),
        fixtures.regional_plan(spark),
        fixtures.mapping(spark),
        PROFILES["caribbean"],
    )
    assert df.first().FY23 == 50_240.0
