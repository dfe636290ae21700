"""The star-schema tables seen as results, plan, mapping and hierarchy.

Every input row comes from the given tables: an order line is a reported or planned value, its part
the indicator, its order's priority the disaggregate and its customer the site.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.profiles import PROFILES, Profile

# The columns used here, so that no job is run to infer them. Integers of either width fit BIGINT.
COLUMNS = {
    "region": "r_regionkey BIGINT, r_name STRING",
    "nation": "n_nationkey BIGINT, n_name STRING, n_regionkey BIGINT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey BIGINT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_brand STRING, p_type STRING, p_size BIGINT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber BIGINT, "
    "l_quantity DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}

DETAILS = ("indicator", "numeratordenom", "standardizeddisaggregate", "fiscal_year")

# A line shipped in 1997 counts for fiscal year 2023.
YEARS_AHEAD = 26

CARIBBEAN_NATIONS = ("NATION_2", "NATION_7")
CENTRAL_NATIONS = ("NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23")


def _scoped(name: str, operatingunit: str, countries: tuple[str, ...] = ()) -> Profile:
    return replace(PROFILES[name], operatingunit=operatingunit, countries=countries)


DOMINICAN_REPUBLIC = _scoped("dominican_republic", "AMERICA")
CARIBBEAN = _scoped("caribbean", "ASIA", CARIBBEAN_NATIONS)
CARIBBEAN_BY_COUNTRY = _scoped("caribbean_by_country", "ASIA", CARIBBEAN_NATIONS)
CENTRAL_AMERICA = _scoped("central_america", "EUROPE", CENTRAL_NATIONS)
CENTRAL_AMERICA_BY_COUNTRY = _scoped("central_america_by_country", "EUROPE", CENTRAL_NATIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


INDICATOR_OF_PART = """
  CASE WHEN p_type = 'ECONOMY' AND p_size > 45 THEN 'VMMC_CIRC'
       WHEN p_type = 'ECONOMY' THEN 'HTS_TST'
       WHEN p_type = 'LARGE' THEN 'PrEP_NEW'
       WHEN p_type = 'MEDIUM' AND p_size > 45 THEN 'TB_STAT'
       WHEN p_type = 'MEDIUM' THEN 'KP_PREV'
       WHEN p_type = 'PROMO' AND p_size > 45 THEN 'GEND_GBV'
       WHEN p_type = 'PROMO' THEN 'HTS_SELF'
       WHEN p_type = 'SMALL' THEN 'PrEP_CT'
       WHEN p_type = 'STANDARD' AND p_size > 45 THEN 'TX_CURR'
       WHEN p_type = 'STANDARD' THEN 'OVC_SERV' END AS indicator
"""
DISAGGREGATE_OF_ORDER = """
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'KeyPop'
       WHEN o_orderpriority = '2-HIGH' THEN 'KeyPop/HIVStatus'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Age/Sex'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Age/Sex/HIVStatus'
       WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' THEN 'Total Numerator'
  END AS disaggregate
"""
YEAR = f"CAST(year(l_shipdate) + {YEARS_AHEAD} AS INT)"
REPORTED_LINE = (
    "indicator",
    "CASE WHEN l_linestatus = 'F' THEN 'D' WHEN l_returnflag <> 'R' THEN 'N' END AS numeratordenom",
    """
    CASE WHEN disaggregate = 'KeyPop' AND indicator = 'PrEP_NEW' THEN 'KeyPopAbr'
         WHEN disaggregate = 'Age/Sex/HIVStatus' AND indicator = 'OVC_SERV'
           THEN 'Age/Sex/ProgramStatusCaregiver'
         WHEN disaggregate = 'Age/Sex/HIVStatus' AND indicator = 'HTS_SELF'
           THEN 'Age/Sex/HIVSelfTest'
         ELSE disaggregate END AS standardizeddisaggregate
    """,
    f"{YEAR} AS fiscal_year",
    f"""
    CASE WHEN indicator = 'GEND_GBV' OR (indicator = 'VMMC_CIRC' AND {YEAR} < 2024) THEN NULL
         ELSE l_quantity END AS targets
    """,
    "CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS cumulative",
    "p_brand AS funding_agency",
    "CAST(l_suppkey AS STRING) AS mech_code",
    """
    CASE WHEN l_linenumber <= 3 THEN 'DATIM' WHEN l_linenumber <= 5 THEN 'Derived' END
      AS source_name
    """,
)


def _new_year(fiscal_year: int) -> Column:
    return F.lit(f"{fiscal_year - YEARS_AHEAD}-01-01").cast("timestamp_ntz")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a site: operating unit, country, name and id."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    countries = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return customer.join(countries, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey",
        "c_acctbal",
        "c_mktsegment",
        "r_name AS operatingunit",
        "n_name AS country",
        "c_name AS psnu",
        "CAST(c_custkey AS STRING) AS psnuuid",
    )


def fact(
    spark: SparkSession,
    sf_dir: str,
    located: bool = True,
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """One row per order line. Without ``located``, sites are left out and not joined.

    Year bounds become bounds on the ship date, which reach the scan. Orders meet their sites before
    the lines, so a filter on places shrinks the largest join.
    """
    lines, orders, part = (table(spark, sf_dir, name) for name in ("lineitem", "orders", "part"))
    if first_year is not None:
        lines = lines.where(F.col("l_shipdate") >= _new_year(first_year))
    if last_year is not None:
        lines = lines.where(F.col("l_shipdate") < _new_year(last_year + 1))
    orders = orders.selectExpr("o_orderkey", "o_custkey", DISAGGREGATE_OF_ORDER)
    if located:
        orders = orders.join(sites(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part.selectExpr("p_partkey", "p_brand", INDICATOR_OF_PART),
        F.col("l_partkey") == F.col("p_partkey"),
    )
    place = ["operatingunit", "country", "psnu", "psnuuid", "c_mktsegment"] if located else []
    return joined.selectExpr(*place, *REPORTED_LINE)


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fiscal year of every order line, from the lines alone."""
    return table(spark, sf_dir, "lineitem").selectExpr(f"{YEAR} AS fiscal_year")


def results(spark: SparkSession, sf_dir: str, located: bool = True) -> DataFrame:
    """Reported rows: fiscal years up to 2023."""
    return fact(spark, sf_dir, located, last_year=2023).drop("c_mktsegment")


MARKED_SITE = """
  CASE WHEN c_mktsegment = 'MACHINERY' THEN psnu || '_Military'
       WHEN c_mktsegment = 'BUILDING' THEN ' ' || psnu || '\t' ELSE psnu END AS psnu
"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row as a plan would have it: site names not yet clean."""
    return fact(spark, sf_dir).selectExpr(
        "operatingunit", "country", MARKED_SITE, "psnuuid", *DETAILS, "targets", "cumulative"
    )


def plan(spark: SparkSession, sf_dir: str, profile: Profile) -> DataFrame:
    """Planned rows of one region: from 2024, few disaggregates, and site names not yet clean."""
    rows = fact(spark, sf_dir, first_year=2024).where(
        (F.col("operatingunit") == profile.operatingunit)
        & F.expr(
            """indicator <> 'GEND_GBV'
            AND (standardizeddisaggregate IN ('Age/Sex', 'KeyPop', 'KeyPopAbr')
              OR (indicator = 'PrEP_CT' AND numeratordenom = 'N'
                  AND standardizeddisaggregate = 'Age/Sex/HIVStatus'))"""
        )
    )
    if profile.countries:
        rows = rows.where(F.col("country").isin(*profile.countries))
    return rows.selectExpr(
        "operatingunit",
        "country",
        MARKED_SITE,
        "psnuuid",
        "indicator",
        "numeratordenom",
        """CASE WHEN standardizeddisaggregate = 'KeyPopAbr' THEN 'KeyPop'
                ELSE standardizeddisaggregate END AS standardizeddisaggregate""",
        "fiscal_year",
        "targets",
        "cumulative",
    )


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid triples of every indicator in the part table, before adjustment."""

    def triple(kind: str | None, disaggregate: str, indicator: str | None = None) -> Column:
        row = F.struct(
            F.lit(kind).cast("string").alias("numeratordenom"),
            F.lit(disaggregate).alias("standardizeddisaggregate"),
        )
        return row if indicator is None else F.when(F.col("indicator") == indicator, row)

    triples = F.array(
        triple("N", "Age/Sex"),
        triple("D", "Age/Sex"),
        triple("N", "KeyPop"),
        triple("D", "KeyPop"),
        triple(None, "Age/Sex", "HTS_TST"),
        triple("N", "Age/Sex/HIVStatus", "PrEP_CT"),
        triple("N", "Age/Sex/HIVSelfTest", "HTS_SELF"),
    )
    return (
        table(spark, sf_dir, "part")
        .selectExpr(INDICATOR_OF_PART)
        .distinct()
        .withColumn("triple", F.explode(F.array_compact(triples)))
        .select("indicator", "triple.numeratordenom", "triple.standardizeddisaggregate")
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a country; customers in debt are not registered, so plans fall back on them."""
    return (
        sites(spark, sf_dir)
        .where(F.col("c_acctbal") >= 0)
        .select("operatingunit", F.col("country").alias("countryname"), "psnu", "psnuuid")
    )
