"""DuckDB SQL for every registered query, written from the rules and not from the Spark plans."""

from __future__ import annotations

# Fixed values, written out here so that a wrong pair in the library does not pass.
COUNTRY_REPORT_EXCLUSIONS = (
    ("GEND_GBV", "Age/Sex/ViolenceType"),
    ("HTS_TST", "KeyPop/Result"),
    ("HTS_TST_POS", "KeyPop/Result"),
    ("PrEP_CT", "KeyPop"),
    ("PrEP_CURR", "KeyPop"),
    ("PrEP_NEW", "KeyPop"),
    ("TB_PREV", "Age/Sex/NewExistingArt/HIVStatus"),
    ("TB_PREV_D", "Age/Sex/NewExistingArt/HIVStatus"),
    ("TX_CURR", "KeyPop/HIVStatus"),
    ("TX_NEW", "KeyPop/HIVStatus"),
    ("TX_TB_D", "Age Aggregated/Sex/TBScreen/NewExistingART/HIVStatus"),
    ("PrEP_CT", "Age/Sex/HIVStatus"),
    ("TX_PVLS", "KeyPop/HIVStatus"),
    ("TX_PVLS_D", "KeyPop/HIVStatus"),
)
REGIONAL_EXCLUSIONS = (("PrEP_CT", "Age/Sex/HIVStatus"),)

VIEWS = """
parts AS (
  SELECT *,
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
  FROM part
),
fact AS (
  SELECT operatingunit, country, psnu, psnuuid, c_mktsegment, indicator,
    CASE WHEN l_linestatus = 'F' THEN 'D' WHEN l_returnflag <> 'R' THEN 'N' END AS numeratordenom,
    CASE WHEN o_orderpriority = '1-URGENT' AND indicator = 'PrEP_NEW' THEN 'KeyPopAbr'
         WHEN o_orderpriority = '1-URGENT' THEN 'KeyPop'
         WHEN o_orderpriority = '2-HIGH' THEN 'KeyPop/HIVStatus'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'Age/Sex'
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND indicator = 'OVC_SERV'
           THEN 'Age/Sex/ProgramStatusCaregiver'
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND indicator = 'HTS_SELF'
           THEN 'Age/Sex/HIVSelfTest'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Age/Sex/HIVStatus'
         WHEN o_orderpriority = '5-LOW' AND o_orderstatus <> 'P' THEN 'Total Numerator'
    END AS standardizeddisaggregate,
    fiscal_year,
    CASE WHEN indicator = 'GEND_GBV' OR (indicator = 'VMMC_CIRC' AND fiscal_year < 2024) THEN NULL
         ELSE l_quantity END AS targets,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS cumulative,
    p_brand AS funding_agency,
    CAST(l_suppkey AS VARCHAR) AS mech_code,
    CASE WHEN l_linenumber <= 3 THEN 'DATIM' WHEN l_linenumber <= 5 THEN 'Derived' END
      AS source_name
  FROM (
    SELECT *, r_name AS operatingunit, n_name AS country, c_name AS psnu,
      CAST(c_custkey AS VARCHAR) AS psnuuid,
      CAST(year(l_shipdate) + 26 AS INTEGER) AS fiscal_year
    FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
    JOIN parts ON l_partkey = p_partkey
  )
),
results AS (SELECT * EXCLUDE (c_mktsegment) FROM fact WHERE fiscal_year <= 2023),
marked AS (
  SELECT * REPLACE (
    CASE WHEN c_mktsegment = 'MACHINERY' THEN psnu || '_Military'
         WHEN c_mktsegment = 'BUILDING' THEN ' ' || psnu || chr(9)
         ELSE psnu END AS psnu)
  FROM fact
),
plan_all AS (
  SELECT operatingunit, country, psnu, psnuuid, indicator, numeratordenom,
    CASE WHEN standardizeddisaggregate = 'KeyPopAbr' THEN 'KeyPop'
         ELSE standardizeddisaggregate END AS standardizeddisaggregate,
    fiscal_year, targets, cumulative
  FROM marked
  WHERE fiscal_year >= 2024 AND indicator <> 'GEND_GBV'
    AND (standardizeddisaggregate IN ('Age/Sex', 'KeyPop', 'KeyPopAbr')
      OR (indicator = 'PrEP_CT' AND numeratordenom = 'N'
          AND standardizeddisaggregate = 'Age/Sex/HIVStatus'))
),
indicators AS (SELECT DISTINCT indicator FROM parts),
mapping AS (
  SELECT indicator, unnest(['N', 'D', 'N', 'D']) AS numeratordenom,
    unnest(['Age/Sex', 'Age/Sex', 'KeyPop', 'KeyPop']) AS standardizeddisaggregate
  FROM indicators
  UNION ALL SELECT indicator, NULL, 'Age/Sex' FROM indicators WHERE indicator = 'HTS_TST'
  UNION ALL SELECT indicator, 'N', 'Age/Sex/HIVStatus' FROM indicators
    WHERE indicator = 'PrEP_CT'
  UNION ALL SELECT indicator, 'N', 'Age/Sex/HIVSelfTest' FROM indicators
    WHERE indicator = 'HTS_SELF'
),
adjusted AS (
  SELECT * FROM (
    SELECT indicator, numeratordenom,
      CASE WHEN indicator = 'PrEP_NEW' AND standardizeddisaggregate = 'KeyPop' THEN 'KeyPopAbr'
           ELSE standardizeddisaggregate END AS standardizeddisaggregate
    FROM mapping)
  WHERE NOT (indicator = 'HTS_SELF'
    AND standardizeddisaggregate IN ('Age/Sex/HIVSelfTest', 'KeyPop/HIVSelfTest'))
),
sites AS (
  SELECT r_name AS operatingunit, n_name AS countryname, c_name AS psnu,
    CAST(c_custkey AS VARCHAR) AS psnuuid, c_acctbal, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
hierarchy AS (
  SELECT operatingunit, countryname, psnu, psnuuid FROM sites WHERE c_acctbal >= 0
),
yearly AS (
  SELECT psnu, indicator, fiscal_year, coalesce(sum(targets), 0) AS targets
  FROM fact GROUP BY ALL
),
wide AS (
  SELECT psnu, indicator,
    max(targets) FILTER (fiscal_year = 2021) AS "FY21",
    max(targets) FILTER (fiscal_year = 2022) AS "FY22",
    max(targets) FILTER (fiscal_year = 2023) AS "FY23",
    max(targets) FILTER (fiscal_year = 2024) AS "FY24",
    max(targets) FILTER (fiscal_year = 2025) AS "FY25",
    max(targets) FILTER (fiscal_year = 2026) AS "FY26",
    max(targets) FILTER (fiscal_year = 2027) AS "FY27"
  FROM yearly GROUP BY ALL
)
"""

CLEAN = "CASE WHEN numeratordenom = 'D' THEN indicator || '_D' ELSE indicator END"
POPULATION = (
    "CASE WHEN NOT contains(standardizeddisaggregate, 'Key') THEN 'Age/Sex' ELSE 'KeyPop' END"
)
TRIPLE = "indicator, numeratordenom, standardizeddisaggregate"
DETAIL = "indicator, standardizeddisaggregate, fiscal_year"
SAME_TRIPLE = """a.indicator IS NOT DISTINCT FROM r.indicator
  AND a.numeratordenom IS NOT DISTINCT FROM r.numeratordenom
  AND a.standardizeddisaggregate IS NOT DISTINCT FROM r.standardizeddisaggregate"""
SITE_NAME = "trim(regexp_replace(psnu, '_Military', ''), ' ' || chr(9))"
UNSCOPED = f"{TRIPLE}, fiscal_year, targets, mech_code, source_name"
SCOPED = f"operatingunit, country, psnuuid, {TRIPLE}, fiscal_year, targets, cumulative"

AMERICA = "operatingunit = 'AMERICA'"
ASIA = "operatingunit = 'ASIA' AND country IN ('NATION_2', 'NATION_7')"
EUROPE = (
    "operatingunit = 'EUROPE' AND country IN "
    "('NATION_3', 'NATION_8', 'NATION_13', 'NATION_18', 'NATION_23')"
)


def with_views(select: str, views: str = "") -> str:
    return f"WITH {VIEWS}{',' if views else ''}{views}\n{select}"


def no_pairs(pairs) -> str:
    return " AND ".join(
        f"NOT (indicator = '{one}' AND standardizeddisaggregate = '{other}')"
        for one, other in pairs
    )


def matched(scope: str, rows: str = "results") -> str:
    """Result rows in scope that the mapping lists, with their final names."""
    return f"""
kept AS (
  SELECT * FROM {rows} r WHERE {scope}
    AND EXISTS (SELECT 1 FROM adjusted a WHERE {SAME_TRIPLE})
),
matched AS (
  SELECT * EXCLUDE (indicator, standardizeddisaggregate, cleaned), cleaned AS indicator,
    CASE WHEN cleaned = 'PrEP_NEW' AND standardizeddisaggregate = 'KeyPopAbr' THEN 'KeyPop'
         ELSE standardizeddisaggregate END AS standardizeddisaggregate
  FROM (SELECT *, {CLEAN} AS cleaned FROM kept)
)"""


def placed(scope: str, operatingunit: str) -> str:
    """The 2024 plan in scope with cleaned sites and the country found for each."""
    return f"""
cleaned_plan AS (
  SELECT '{operatingunit}' AS operatingunit, {SITE_NAME} AS psnu, psnuuid, {CLEAN} AS indicator,
    numeratordenom, standardizeddisaggregate, fiscal_year, targets
  FROM plan_all WHERE {scope} AND fiscal_year = 2024
),
placed AS (
  SELECT p.*, coalesce(h.countryname, p.psnu) AS country
  FROM cleaned_plan p LEFT JOIN (SELECT DISTINCT * FROM hierarchy) h
    ON p.operatingunit IS NOT DISTINCT FROM h.operatingunit
    AND p.psnu IS NOT DISTINCT FROM h.psnu AND p.psnuuid IS NOT DISTINCT FROM h.psnuuid
)"""


def round_two(x: str) -> str:
    """Two digits: the nearer neighbouring double, the even one on a tie; 0.0 takes zero's sign."""
    low, high = f"(floor(({x}) * 100) / 100)", f"(ceil(({x}) * 100) / 100 + 0.0)"
    return f"""CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN ({x})
      WHEN ({x}) - {low} < {high} - ({x}) THEN {low}
      WHEN ({x}) - {low} > {high} - ({x}) THEN {high}
      WHEN floor(({x}) * 100) % 2 = 0 THEN {low} ELSE {high} END"""


def percent(x: str) -> str:
    return f"""CASE WHEN ({x}) IS NULL OR isnan({x}) THEN NULL
      WHEN isinf({x}) THEN CASE WHEN ({x}) > 0 THEN 'Inf%' ELSE '-Inf%' END
      ELSE CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) || '%' END"""


def whole(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


def percent_change(before: str, after: str) -> str:
    return percent(f"({after} - {before}) / {before} * 100")


def country_views() -> str:
    """The country report: results with the supplement, plan, exclusions, re-summed and pivoted."""
    return f"""{matched(AMERICA)},
caregivers AS (
  SELECT {CLEAN} AS indicator, standardizeddisaggregate, fiscal_year, targets, cumulative
  FROM results WHERE {AMERICA} AND indicator = 'OVC_SERV' AND fiscal_year >= 2022
    AND standardizeddisaggregate = 'Age/Sex/ProgramStatusCaregiver'
),
both_sides AS (
  SELECT {DETAIL}, targets, cumulative FROM matched
  UNION ALL SELECT {DETAIL}, targets, cumulative FROM caregivers
  UNION ALL SELECT {CLEAN}, standardizeddisaggregate, fiscal_year, targets, NULL
  FROM plan_all WHERE {AMERICA} AND fiscal_year = 2024
),
coarse AS (
  SELECT indicator, {POPULATION} AS all_or_KP, fiscal_year,
    coalesce(sum(targets), 0) AS targets, coalesce(sum(cumulative), 0) AS cumulative
  FROM both_sides
  WHERE fiscal_year >= 2022 AND {no_pairs(COUNTRY_REPORT_EXCLUSIONS)} GROUP BY ALL
),
pivoted AS (
  SELECT indicator, all_or_KP,
    max(targets) FILTER (fiscal_year = 2022) AS "targets_FY22",
    max(cumulative) FILTER (fiscal_year = 2022) AS "cumulative_FY22",
    max(targets) FILTER (fiscal_year = 2023) AS "targets_FY23",
    max(cumulative) FILTER (fiscal_year = 2023) AS "cumulative_FY23",
    max(targets) FILTER (fiscal_year = 2024) AS "targets_FY24"
  FROM coarse GROUP BY ALL
),
compared AS (
  SELECT *, targets_FY24 - targets_FY23 AS targets_diff_fy_24_23,
    {round_two("(targets_FY24 - targets_FY23) / targets_FY23")} AS targets_percent_change_24_23
  FROM pivoted WHERE NOT (targets_FY23 = 0 AND targets_FY24 IS NULL)
)"""


def regional_views(scope: str, operatingunit: str, by_country: bool, central: bool) -> str:
    """A regional report; the Central America rules drop TB_STAT and keep zero-and-absent rows."""
    ids = "country, indicator" if by_country else "indicator"
    if by_country:
        planned = f"SELECT country, {DETAIL}, targets FROM placed"
    else:
        planned = f"SELECT NULL AS country, {DETAIL}, targets FROM cleaned_plan"
    no_tuberculosis = "AND indicator NOT IN ('TB_STAT', 'TB_STAT_D')" if central else ""
    zero_and_absent = "" if central else 'WHERE NOT ("FY23" = 0 AND "FY24" IS NULL)'
    return f"""{matched(scope)},{placed(scope, operatingunit)},
both_sides AS (
  SELECT country, {DETAIL}, targets FROM matched UNION ALL {planned}
),
fine AS (
  SELECT {ids}, standardizeddisaggregate, fiscal_year, coalesce(sum(targets), 0) AS targets
  FROM both_sides
  WHERE fiscal_year > 2022 AND {no_pairs(REGIONAL_EXCLUSIONS)} {no_tuberculosis} GROUP BY ALL
),
combined AS (SELECT *, {POPULATION} AS all_or_KP FROM fine),
pivoted AS (
  SELECT {ids}, all_or_KP,
    max(targets) FILTER (fiscal_year = 2023) AS "FY23",
    max(targets) FILTER (fiscal_year = 2024) AS "FY24"
  FROM combined GROUP BY ALL
),
compared AS (
  SELECT *, "FY24" - "FY23" AS diff, {percent_change('"FY23"', '"FY24"')} AS percent_change
  FROM pivoted {zero_and_absent}
)"""


CARIBBEAN = regional_views(ASIA, "ASIA", False, False)
CARIBBEAN_BY_COUNTRY = regional_views(ASIA, "ASIA", True, False)
CENTRAL_AMERICA = regional_views(EUROPE, "EUROPE", False, True)
CENTRAL_AMERICA_BY_COUNTRY = regional_views(EUROPE, "EUROPE", True, True)


EVERY_YEAR = f"""{matched(f"{ASIA} AND fiscal_year <> 2024", "fact")},{placed(ASIA, "ASIA")},
sums AS (
  SELECT indicator, {POPULATION} AS all_or_KP, fiscal_year, coalesce(sum(targets), 0) AS targets
  FROM (SELECT {DETAIL}, targets FROM matched UNION ALL SELECT {DETAIL}, targets FROM cleaned_plan)
  WHERE fiscal_year >= 2022 AND {no_pairs(REGIONAL_EXCLUSIONS)} GROUP BY ALL
),
pivoted AS (
  SELECT indicator, all_or_KP,
    {", ".join(f'max(targets) FILTER (fiscal_year = {y}) AS "FY{y - 2000}"' for y in range(2022, 2028))}
  FROM sums GROUP BY ALL
)"""


def country_table(section: str, title: str, heading: str, percent_text: bool = False) -> str:
    shown = {
        "targets_FY22": "targets_FY22",
        "cumulative_FY22": "results_FY22",
        "targets_FY23": "targets_FY23",
        "cumulative_FY23": "results_FY23",
        "targets_FY24": "targets_FY24",
        "targets_diff_fy_24_23": "targets change_FY24_23",
    }
    numbers = ", ".join(f'{whole(old)} AS "{new}"' for old, new in shown.items())
    change = "targets_percent_change_24_23"
    as_percent = f"""CASE WHEN {change} IS NULL OR isnan({change}) THEN NULL
      WHEN isinf({change}) THEN CASE WHEN {change} > 0 THEN 'Inf%' ELSE '-Inf%' END
      ELSE {whole(f"{change} * 100")} || '%' END"""
    if percent_text:
        as_percent = percent_change("targets_FY23", "targets_FY24")
    select = f"""SELECT 'Dominican Republic Target Summary' AS report, '{title}' AS section,
      indicator, {numbers}, {as_percent} AS "{heading}" FROM compared WHERE {section}"""
    return with_views(select, country_views())


ALL_SECTION = "all_or_KP = 'Age/Sex' OR indicator = 'KP_PREV'"
KEY_SECTION = "all_or_KP = 'KeyPop'"
CHECKED = "indicator IN ('HTS_SELF', 'PrEP_NEW', 'GEND_GBV', 'OVC_SERV')"


def sums_of(kind: str, cumulative: str) -> str:
    return f"""SELECT {DETAIL}, coalesce(sum(targets), 0) AS targets, {cumulative} AS cumulative
      FROM fact WHERE numeratordenom = '{kind}' GROUP BY {DETAIL}"""


def completeness(indicators: str, source: str) -> str:
    return f"""SELECT s.fiscal_year, s.indicator, s.standardizeddisaggregate, age_sex_sum,
      total_numerator, total_numerator - age_sex_sum AS difference
    FROM (
      SELECT {DETAIL}, coalesce(sum(targets), 0) AS age_sex_sum FROM fact
      WHERE {CHECKED} AND contains(standardizeddisaggregate, 'Age/Sex') {source} GROUP BY {DETAIL}
    ) s LEFT JOIN (
      SELECT fiscal_year, indicator, coalesce(sum(targets), 0) AS total_numerator FROM fact
      WHERE {indicators} AND standardizeddisaggregate = 'Total Numerator'
      GROUP BY fiscal_year, indicator
    ) t ON s.fiscal_year IS NOT DISTINCT FROM t.fiscal_year
      AND s.indicator IS NOT DISTINCT FROM t.indicator"""


CUMULATIVE_SUM = "coalesce(sum(cumulative), 0)"



def year_cell(measure: str, year: int) -> str:
    at = f"FILTER (fiscal_year = {year})"
    return f"""CASE WHEN count(*) {at} > 0 THEN coalesce(sum({measure}) {at}, 0) END
      AS "{measure}_FY{year - 2000}\""""


ALL_YEARS = ", ".join(year_cell(m, y) for m in ("targets", "cumulative") for y in range(2021, 2028))

ORACLE = {
    "newest_source": (
        "SELECT o_orderpriority, count(*) AS n_orders FROM orders GROUP BY o_orderpriority"
    ),
    "newest_of_several": """SELECT o_orderpriority, count(*) AS n_orders FROM orders
      WHERE o_orderstatus = 'P' GROUP BY o_orderpriority""",
    "conform_types": with_views(
        f"SELECT operatingunit, country, {TRIPLE}, fiscal_year, targets, cumulative, mech_code FROM fact"
    ),
    "damaged_lines": """
WITH lines AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'too few fields' WHEN o_orderkey % 7 = 0 THEN 'too many fields'
      WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'open quote' ELSE 'none' END AS reason,
    length(o_orderpriority) + length(o_orderstatus) + length(CAST(o_orderkey AS VARCHAR)) + 2 AS whole,
    length(CAST(o_orderkey AS VARCHAR)) AS digits
  FROM orders)
SELECT reason, count(*) AS n_lines, CAST(sum(CASE reason WHEN 'too few fields' THEN whole - digits - 1
  WHEN 'too many fields' THEN whole + 6 WHEN 'open quote' THEN whole + 1 ELSE whole END) AS BIGINT) AS n_chars
FROM lines GROUP BY reason
""",
    "column_listing": with_views(
        f"SELECT operatingunit, country, psnu, psnuuid, {TRIPLE}, fiscal_year, targets FROM fact"
    ),
    "select_any_of": with_views(
        "SELECT country, indicator, mech_code, targets, funding_agency FROM fact"
    ),
    "strict_select": with_views("SELECT operatingunit, countryname, psnu, psnuuid FROM sites"),
    "drop_columns": with_views(
        f"""SELECT country, psnu, psnuuid, {TRIPLE}, fiscal_year, targets, funding_agency, mech_code,
          source_name FROM fact"""
    ),
    "rename": with_views(
        "SELECT operatingunit, countryname AS country, psnu AS site, psnuuid FROM sites"
    ),
    "relocate": with_views("SELECT * FROM wide"),
    "derive": with_views(
        """SELECT mech_code, indicator, targets, cumulative,
          'Western Hemisphere Region' AS operatingunit, targets - cumulative AS gap,
          (targets - cumulative) * 2 AS double_gap FROM fact"""
    ),
    "unpivot_plan": with_views("SELECT * FROM yearly"),
    "filter_scope": with_views(f"SELECT {SCOPED} FROM fact WHERE {ASIA}"),
    "filter_year_text": with_views(f"SELECT {UNSCOPED} FROM fact WHERE fiscal_year = 2023"),
    "filter_year_range": with_views(
        f"SELECT {UNSCOPED} FROM fact WHERE fiscal_year > 2022 AND fiscal_year <= 2024"
    ),
    "filter_membership": with_views(f"SELECT {UNSCOPED} FROM fact WHERE {CHECKED}"),
    "filter_not_in_null_safe": with_views(
        f"""SELECT {UNSCOPED} FROM fact WHERE source_name IS DISTINCT FROM 'Derived'
          AND indicator IS DISTINCT FROM 'TB_STAT' AND indicator IS DISTINCT FROM 'TB_STAT_D'"""
    ),
    "exclude_pairs": with_views(
        f"""SELECT {UNSCOPED}
          FROM (SELECT * REPLACE ({CLEAN} AS indicator) FROM fact)
          WHERE {no_pairs(COUNTRY_REPORT_EXCLUSIONS)}"""
    ),
    "guarded_exclusion": with_views(
        f"""SELECT {UNSCOPED} FROM fact WHERE indicator <> 'HTS_SELF'
          OR standardizeddisaggregate IS NULL
          OR standardizeddisaggregate NOT IN ('Age/Sex/HIVSelfTest', 'KeyPop/HIVSelfTest')"""
    ),
    "substring_filter": with_views(
        f"SELECT {UNSCOPED} FROM fact WHERE standardizeddisaggregate LIKE '%Age/Sex%'"
    ),
    "zero_and_absent_filter": with_views(
        """SELECT * FROM wide
          WHERE NOT ("FY23" = 0 AND "FY24" IS NULL)"""
    ),
    "semi_join_mapping": with_views(
        f"""SELECT {UNSCOPED} FROM fact r
          WHERE EXISTS (SELECT 1 FROM adjusted a WHERE {SAME_TRIPLE})"""
    ),
    "left_join_hierarchy": with_views(
        f"""SELECT p.operatingunit, p.psnu, p.psnuuid, h.countryname, {DETAIL}, targets
          FROM (SELECT * REPLACE ({SITE_NAME} AS psnu) FROM marked) p
          LEFT JOIN hierarchy h ON p.operatingunit IS NOT DISTINCT FROM h.operatingunit
            AND p.psnu IS NOT DISTINCT FROM h.psnu AND p.psnuuid IS NOT DISTINCT FROM h.psnuuid"""
    ),
    "left_join_totals": with_views(completeness("indicator IN ('HTS_SELF', 'PrEP_NEW')", "")),
    "na_sum_one": with_views(
        f"""SELECT country, {DETAIL}, coalesce(sum(targets), 0) AS targets
          FROM fact GROUP BY country, {DETAIL}"""
    ),
    "na_sum_many": with_views(
        f"""SELECT {TRIPLE}, fiscal_year, coalesce(sum(targets), 0) AS targets,
          coalesce(sum(cumulative), 0) AS cumulative FROM fact GROUP BY {TRIPLE}, fiscal_year"""
    ),
    "resum_coarser": with_views(
        f"""SELECT indicator, fiscal_year, {POPULATION} AS all_or_KP,
          coalesce(sum(targets), 0) AS targets, coalesce(sum(cumulative), 0) AS cumulative
          FROM fact GROUP BY ALL"""
    ),
    "distinct_hierarchy": with_views("SELECT DISTINCT operatingunit, countryname FROM sites"),
    "bind_rows_fill": with_views(
        f"{sums_of('N', CUMULATIVE_SUM)} UNION ALL {sums_of('D', 'NULL')}"
    ),
    "union_strict": with_views(
        f"{sums_of('N', CUMULATIVE_SUM)} UNION ALL {sums_of('D', CUMULATIVE_SUM)}"
    ),
    "pivot_one": with_views("SELECT * FROM wide"),
    "pivot_unlisted": with_views(
        """SELECT psnu, indicator, "FY23", "FY24" FROM wide
          WHERE "FY23" IS NOT NULL OR "FY24" IS NOT NULL"""
    ),
    "pivot_names_found": with_views("SELECT * FROM wide"),
    "pivot_two": with_views(
        f"SELECT indicator, {POPULATION} AS all_or_KP, {ALL_YEARS} FROM fact GROUP BY ALL"
    ),
    "sort_nulls_last": with_views(
        f"""SELECT country, {TRIPLE}, coalesce(sum(targets), 0) AS targets FROM fact
          GROUP BY country, {TRIPLE} ORDER BY ALL NULLS LAST"""
    ),
    "case_when_without_default": with_views(
        """SELECT mech_code, indicator, targets, cumulative,
          CASE WHEN cumulative IS NULL THEN 'missing' WHEN targets > 25 THEN 'large' END AS size
          FROM fact"""
    ),
    "fiscal_label": (
        """SELECT regexp_replace(CAST(year(l_shipdate) + 26 AS VARCHAR), '20', 'FY') AS label,
          count(*) AS n_rows FROM lineitem GROUP BY ALL"""
    ),
    "replace_first_match": with_views(
        """SELECT psnuuid, regexp_replace(psnu, '0', 'FY') AS replaced,
          regexp_replace(psnu, '00', '') AS removed FROM sites"""
    ),
    "trim_site_names": with_views(
        f"""SELECT DISTINCT psnuuid, CAST(length(psnu) AS INTEGER) AS length,
          {SITE_NAME} AS cleaned FROM marked"""
    ),
    "ieee_ratio": with_views(
        """SELECT psnu, indicator, ("FY24" - "FY23") / "FY23" AS change FROM wide
          WHERE "FY23" IS NOT NULL AND "FY24" IS NOT NULL"""
    ),
    "rounded_ratio": with_views(
        f"""SELECT psnu, indicator, round_even(share, 0) AS whole,
          {round_two("share")} AS two_digits, {percent("share")} AS as_percent
          FROM (SELECT psnu, indicator, "FY24" / 8.0::DOUBLE AS share FROM wide)"""
    ),
    "format_integer": with_views(
        f"""SELECT psnu, indicator, {whole('"FY24" * 1234.5::DOUBLE')} AS shown FROM wide"""
    ),
    "format_percent": with_views(
        f"""SELECT psnu, indicator,
          CASE WHEN fraction IS NULL OR isnan(fraction) THEN NULL
            WHEN isinf(fraction) THEN CASE WHEN fraction > 0 THEN 'Inf%' ELSE '-Inf%' END
            ELSE {whole("fraction * 100")} || '%' END AS shown
          FROM (SELECT psnu, indicator, {round_two('("FY24" - "FY23") / "FY23"')} AS fraction
                FROM wide)"""
    ),
    "clean_indicator": with_views(
        f"SELECT {UNSCOPED} FROM (SELECT * REPLACE ({CLEAN} AS indicator) FROM fact)"
    ),
    "adjust_mapping": with_views("SELECT * FROM adjusted"),
    "harmonise_results": with_views(
        f"""SELECT operatingunit, country, psnu, psnuuid, {TRIPLE}, fiscal_year, targets,
          cumulative, funding_agency, mech_code FROM matched""",
        matched(ASIA),
    ),
    "supplement": with_views(
        f"""SELECT {CLEAN} AS indicator, standardizeddisaggregate, fiscal_year,
          coalesce(sum(targets), 0) AS targets, coalesce(sum(cumulative), 0) AS cumulative
          FROM results WHERE {AMERICA} AND indicator = 'OVC_SERV' AND fiscal_year >= 2022
            AND standardizeddisaggregate = 'Age/Sex/ProgramStatusCaregiver' GROUP BY ALL"""
    ),
    "match_or_supplement": with_views(
        f"""SELECT {DETAIL}, coalesce(sum(targets), 0) AS targets,
          coalesce(sum(cumulative), 0) AS cumulative
          FROM (SELECT {DETAIL}, targets, cumulative FROM matched
                UNION ALL SELECT {DETAIL}, targets, cumulative FROM caregivers)
          GROUP BY {DETAIL}""",
        country_views(),
    ),
    "aggregate_plan": with_views(
        f"""SELECT {CLEAN} AS indicator, standardizeddisaggregate, fiscal_year,
          coalesce(sum(targets), 0) AS targets
          FROM plan_all WHERE {ASIA} AND fiscal_year = 2024 GROUP BY ALL"""
    ),
    "assign_country": with_views(
        f"""SELECT operatingunit, psnu, psnuuid, country, raw_indicator AS indicator,
          numeratordenom, standardizeddisaggregate, targets
          FROM (SELECT *, CASE WHEN numeratordenom = 'D' THEN replace(indicator, '_D', '')
                ELSE indicator END AS raw_indicator FROM placed)""",
        placed(ASIA, "ASIA"),
    ),
    "aggregate_plan_by_country": with_views(
        f"""SELECT country, {DETAIL}, coalesce(sum(targets), 0) AS targets
          FROM placed GROUP BY country, {DETAIL}""",
        placed(EUROPE, "EUROPE"),
    ),
    "classify_population": with_views(
        f"""SELECT standardizeddisaggregate, {POPULATION} AS all_or_KP, count(*) AS n_rows
          FROM fact GROUP BY ALL"""
    ),
    "combined_sides": with_views(
        "SELECT indicator, standardizeddisaggregate, fiscal_year, sum(targets) AS targets, "
        "all_or_KP FROM combined GROUP BY ALL",
        CENTRAL_AMERICA,
    ),
    "year_change_fraction": with_views(
        f"""SELECT *, "FY24" - "FY23" AS diff,
          {round_two('("FY24" - "FY23") / "FY23"')} AS change FROM wide"""
    ),
    "year_change_percent": with_views(
        f"""SELECT *, "FY24" - "FY23" AS diff,
          {percent_change('"FY23"', '"FY24"')} AS change FROM wide"""
    ),
    "year_change_other_years": with_views(
        f"""SELECT *, "FY24" - "FY22" AS diff_fy_24_22,
          {percent_change('"FY22"', '"FY24"')} AS percent_change_24_22 FROM wide"""
    ),
    "indicator_total": with_views(
        f"""SELECT {DETAIL}, coalesce(sum(cumulative), 0) AS cumulative FROM fact
          WHERE indicator = 'TX_CURR' AND standardizeddisaggregate = 'Age/Sex/HIVStatus'
            AND fiscal_year = 2023 GROUP BY {DETAIL}"""
    ),
    "indicator_total_of_plan": with_views(
        f"""SELECT {DETAIL}, coalesce(sum(targets), 0) AS targets FROM marked
          WHERE indicator = 'HTS_TST' AND standardizeddisaggregate = 'Age/Sex'
            AND fiscal_year = 2024 GROUP BY {DETAIL}"""
    ),
    "disagg_completeness": with_views(completeness(CHECKED, "AND source_name = 'DATIM'")),
    "list_disaggregates": with_views(
        f"""SELECT DISTINCT fiscal_year, indicator, standardizeddisaggregate FROM fact
          WHERE {CHECKED} AND source_name = 'DATIM'
            AND contains(standardizeddisaggregate, 'Age/Sex')"""
    ),
    "hierarchy_conflicts": with_views(
        """SELECT operatingunit, c_mktsegment AS psnu, right(psnuuid, 2) AS psnuuid,
          count(DISTINCT countryname) AS names, min(countryname) AS first_name,
          max(countryname) AS last_name
          FROM sites GROUP BY ALL HAVING count(DISTINCT countryname) > 1"""
    ),
    "shared_years": with_views(
        """SELECT DISTINCT fiscal_year FROM fact WHERE fiscal_year <= 2024
          INTERSECT SELECT DISTINCT fiscal_year FROM fact WHERE fiscal_year >= 2023"""
    ),
    "absent_years": with_views(
        f"""SELECT fiscal_year
          FROM (SELECT CAST(unnest([2015, 2023, 2024]) AS INTEGER) AS fiscal_year)
          WHERE fiscal_year NOT IN (
            SELECT fiscal_year FROM results WHERE {ASIA}
            UNION SELECT fiscal_year FROM plan_all WHERE {ASIA} AND fiscal_year = 2024)"""
    ),
    "unlisted_years": with_views(
        f"""SELECT DISTINCT fiscal_year FROM (
            SELECT fiscal_year FROM results WHERE {ASIA}
            UNION SELECT fiscal_year FROM plan_all WHERE {ASIA} AND fiscal_year = 2024)
          WHERE fiscal_year > 2021 AND fiscal_year <> 2023"""
    ),
    "unmatched_sites": with_views(
        """SELECT operatingunit, psnu, psnuuid, coalesce(sum(targets), 0) AS targets FROM placed p
          WHERE NOT EXISTS (SELECT 1 FROM hierarchy h WHERE p.psnu = h.psnu
            AND p.psnuuid = h.psnuuid AND p.operatingunit = h.operatingunit)
          GROUP BY ALL""",
        placed(ASIA, "ASIA"),
    ),
    "compare_dr": with_views("SELECT * FROM compared", country_views()),
    "compare_caribbean": with_views("SELECT * FROM compared", CARIBBEAN),
    "compare_caribbean_from_sums": with_views("SELECT * FROM compared", CARIBBEAN),
    "completeness_from_sums": with_views(
        completeness(CHECKED, "AND source_name = 'DATIM'").replace("FROM fact", "FROM results")
    ),
    "compare_caribbean_all_years": with_views(
        f"""SELECT *, "FY23" - "FY22" AS diff, {percent_change('"FY22"', '"FY23"')} AS percent_change
          FROM pivoted WHERE NOT ("FY22" = 0 AND "FY23" IS NULL)""",
        EVERY_YEAR,
    ),
    "compare_caribbean_by_country": with_views("SELECT * FROM compared", CARIBBEAN_BY_COUNTRY),
    "compare_central_america": with_views("SELECT * FROM compared", CENTRAL_AMERICA),
    "compare_central_america_by_country": with_views(
        "SELECT * FROM compared", CENTRAL_AMERICA_BY_COUNTRY
    ),
    "section_all": with_views(f"SELECT * FROM compared WHERE {ALL_SECTION}", CARIBBEAN),
    "section_key": with_views(f"SELECT * FROM compared WHERE {KEY_SECTION}", CARIBBEAN),
    "both_sections": with_views(
        f"""SELECT *, 'all' AS section FROM compared WHERE {ALL_SECTION}
          UNION ALL SELECT *, 'key' AS section FROM compared WHERE {KEY_SECTION}""",
        CARIBBEAN_BY_COUNTRY,
    ),
    "report_table_all": country_table(
        ALL_SECTION, "All Populations", "targets % change FY24_FY23"
    ),
    "report_table_key": country_table(
        KEY_SECTION, "Key Populations", "targets % change FY24-FY23"
    ),
    "report_table_percent_text": country_table(
        ALL_SECTION, "All Populations", "targets % change FY24_FY23", percent_text=True
    ),
    "report_table_by_country": with_views(
        f"""SELECT 'Central America Target Summary' AS report, 'All Populations' AS section,
          country, indicator, "FY23", "FY24", diff AS change, percent_change AS "% change"
          FROM compared WHERE {ALL_SECTION}""",
        CENTRAL_AMERICA_BY_COUNTRY,
    ),
}
