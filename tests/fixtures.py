"""Small invented tables with known answers."""

from dataclasses import replace

from plumbline import PROFILES

RESULTS = (
    "operatingunit STRING, country STRING, indicator STRING, numeratordenom STRING, "
    "standardizeddisaggregate STRING, fiscal_year INT, targets DOUBLE, cumulative DOUBLE, "
    "funding_agency STRING, mech_code STRING, source_name STRING"
)
PLAN = (
    "operatingunit STRING, country STRING, psnu STRING, psnuuid STRING, indicator STRING, "
    "numeratordenom STRING, standardizeddisaggregate STRING, fiscal_year INT, targets DOUBLE, "
    "cumulative DOUBLE"
)
MAPPING = "indicator STRING, numeratordenom STRING, standardizeddisaggregate STRING"
HIERARCHY = "operatingunit STRING, countryname STRING, psnu STRING, psnuuid STRING"

MODALITY, STATUS = "Modality/Age/Sex/Result", "Age/Sex/HIVStatus"
REGION = "Western Hemisphere Region"
ISLANDS = "Trinidad and Tobago"


def mapping(spark):
    rows = [
        ("HTS_TST", "N", MODALITY),
        ("HTS_TST", "N", "KeyPop/Result"),
        ("TX_PVLS", "D", STATUS),
        ("PrEP_NEW", "N", "KeyPop"),
        ("KP_PREV", "N", "KeyPop"),
        ("HTS_SELF", "N", "Age/Sex/HIVSelfTest"),
        ("OVC_SERV", "N", "Age/Sex/ProgramStatus"),
        ("VMMC_CIRC", "N", "Age/Sex"),
        ("CXCA_SCRN", "N", STATUS),
        ("TX_NEW", "N", STATUS),
    ]
    return spark.createDataFrame(rows, MAPPING)


def result(
    unit, country, indicator, kind, disaggregate, year, targets, cumulative=None, source=None
):
    keys = (unit, country, indicator, kind, disaggregate, year)
    return (*keys, targets, cumulative, "agency", "1", source)


def country_results(spark):
    rows = [
        ("HTS_TST", "N", MODALITY, 2022, 100.0, 90.0),
        ("HTS_TST", "N", MODALITY, 2023, 120.0, None),
        ("HTS_TST", "N", MODALITY, 2023, 30.0, 10.0),
        ("HTS_TST", "N", "KeyPop/Result", 2023, 50.0, 5.0),
        ("TX_PVLS", "D", STATUS, 2023, 40.0, 20.0),
        ("PrEP_NEW", "N", "KeyPopAbr", 2023, 8.0, 1.0),
        ("KP_PREV", "N", "KeyPop", 2023, 0.0, 3.0),
        ("HTS_SELF", "N", "Age/Sex/HIVSelfTest", 2023, 9.0, 9.0),
        ("OVC_SERV", "N", "Age/Sex/ProgramStatusCaregiver", 2023, 7.0, 7.0),
        ("OVC_SERV", "N", "Age/Sex/ProgramStatus", 2023, 10.0, None),
        ("VMMC_CIRC", "N", "Age/Sex", 2023, 0.0, 0.0),
        ("GEND_GBV", "N", "Total Numerator", 2023, 4.0, 4.0),
        ("CXCA_SCRN", "N", STATUS, 2022, 5.0, 5.0),
        ("TX_NEW", "N", STATUS, 2023, 20.0, 20.0),
    ]
    here = [result("Dominican Republic", "Dominican Republic", *row) for row in rows]
    elsewhere = result("Elsewhere", "Elsewhere", "HTS_TST", "N", MODALITY, 2023, 999.0, 999.0)
    return spark.createDataFrame([*here, elsewhere], RESULTS)


def country_plan(spark):
    rows = [
        ("HTS_TST", "N", MODALITY, 2024, 165.0),
        ("HTS_TST", "N", MODALITY, 2023, 999.0),
        ("TX_PVLS", "D", STATUS, 2024, 45.0),
        ("KP_PREV", "N", "KeyPop", 2024, 5.0),
        ("OVC_SERV", "N", "Age/Sex/ProgramStatus", 2024, 20.0),
        ("PrEP_CT", "N", STATUS, 2024, 3.0),
        ("PMTCT_STAT", "N", "Age/Sex/KnownNewResult", 2024, 6.0),
    ]
    place = ("Dominican Republic", "Dominican Republic", "Site", "s1")
    return spark.createDataFrame([(*place, *row, None) for row in rows], PLAN)


def regional_results(spark, *extra):
    rows = [
        ("Jamaica", "HTS_TST", MODALITY, 200.0),
        (ISLANDS, "HTS_TST", MODALITY, 40.0),
        ("Haiti", "HTS_TST", MODALITY, 999.0),
        ("Jamaica", "KP_PREV", "KeyPop", 0.0),
        ("Jamaica", "PrEP_NEW", "KeyPopAbr", 8.0),
        ("Jamaica", "VMMC_CIRC", "Age/Sex", 0.0),
        *extra,
    ]
    return spark.createDataFrame(
        [result(REGION, c, i, "N", d, 2023, targets) for c, i, d, targets in rows], RESULTS
    )


def regional_plan(spark):
    rows = [
        ("Kingston", "k1", "HTS_TST", MODALITY, 150.0),
        ("Jamaica_Military", "jm", "HTS_TST", MODALITY, 10.0),
        (" Port of Spain ", "p1", "HTS_TST", MODALITY, 41.0),
        ("Kingston", "k1", "KP_PREV", "KeyPop", 0.0),
        ("Kingston", "k1", "PrEP_NEW", "KeyPop", 12.0),
    ]
    return spark.createDataFrame(
        [(REGION, None, p, u, i, "N", d, 2024, targets, None) for p, u, i, d, targets in rows], PLAN
    )


def hierarchy(spark, *extra):
    rows = [
        (REGION, "Jamaica", "Kingston", "k1"),
        (REGION, "Jamaica", "Kingston", "k1"),
        (REGION, ISLANDS, "Port of Spain", "p1"),
        *extra,
    ]
    return spark.createDataFrame(rows, HIERARCHY)


def central_profile(by_country):
    """The Central America rules over the countries of the regional tables."""
    name = "central_america_by_country" if by_country else "central_america"
    return replace(PROFILES[name], countries=PROFILES["caribbean"].countries)


def completeness_results(spark):
    rows = [
        (2023, "HTS_SELF", "Total Numerator", "DATIM", 100.0),
        (2023, "HTS_SELF", "Total Numerator", "Derived", 5.0),
        (2023, "HTS_SELF", "Age/Sex/HIVSelfTest", "DATIM", 60.0),
        (2023, "HTS_SELF", "4:Age/Sex", "DATIM", 90.0),
        (2023, "HTS_SELF", "Age/Sex", "Derived", 1.0),
        (2023, "GEND_GBV", "Age/Sex/ViolenceType", "DATIM", 12.0),
        (2023, "TX_CURR", "Age/Sex", "DATIM", 12.0),
        (2022, "OVC_SERV", "Total Numerator", "DATIM", 7.0),
        (2023, "PrEP_NEW", "Total Numerator", "DATIM", 9.0),
        (2023, "PrEP_NEW", "Age/Sex", "DATIM", None),
    ]
    made = [
        result("X", "X", indicator, "N", disaggregate, year, targets, None, source)
        for year, indicator, disaggregate, source, targets in rows
    ]
    return spark.createDataFrame(made, RESULTS)
