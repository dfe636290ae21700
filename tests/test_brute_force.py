"""Comparisons of random tables, with missing values everywhere, against plain loops."""

import math
import random
from collections import defaultdict
from dataclasses import replace
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import fixtures
from plumbline import PROFILES, compare
from plumbline.functions import percent_text, ratio, round_half_even

NAN = math.nan
COUNTRIES = ["Jamaica", "Trinidad and Tobago", "Haiti", None]
INDICATORS = ["HTS_TST", "PrEP_NEW", "PrEP_CT", "KP_PREV", "OVC_SERV", "HTS_SELF", "TB_STAT", None]
KINDS = ["N", "N", "D", None]
DISAGGREGATES = [
    "Age/Sex",
    "KeyPop",
    "KeyPopAbr",
    "Age/Sex/HIVStatus",
    "Age/Sex/HIVSelfTest",
    "Age/Sex/ProgramStatusCaregiver",
    None,
]
VALUES = [None, NAN, 0.0, 0.0, 1.0, 2.0, 8.0, 40.0]
SITES = [
    ("Kingston", "k"),
    (" Kingston\t", "k"),
    ("Port_Military", "p"),
    ("Lost", None),
    (None, "q"),
]


def missing(value):
    return value is None or (isinstance(value, float) and math.isnan(value))


def total(values):
    return float(sum(v for v in values if not missing(v)))


def cleaned(indicator, kind):
    return f"{indicator}_D" if kind == "D" and indicator is not None else indicator


def divided(numerator, denominator):
    if numerator is None or denominator is None:
        return None
    if denominator:
        return numerator / denominator
    return NAN if numerator == 0 else math.copysign(math.inf, numerator)


def rounded(x):
    """Two digits by exact distances to the two neighbouring doubles."""
    if missing(x) or math.isinf(x):
        return x
    low, high = math.floor(x * 100) / 100, math.ceil(x * 100) / 100
    to_low, to_high = Fraction(x) - Fraction(low), Fraction(high) - Fraction(x)
    if to_low == to_high:
        return low if math.floor(x * 100) % 2 == 0 else high
    return low if to_low < to_high else high


def percent(x):
    if missing(x):
        return None
    return f"{'-' if x < 0 else ''}Inf%" if math.isinf(x) else f"{round(x)}%"


def expected(results, plan, mapping, hierarchy, profile):
    """The report by loops over rows."""
    listed = set()
    for indicator, kind, disaggregate in mapping:
        if indicator == "PrEP_NEW" and disaggregate == "KeyPop":
            disaggregate = "KeyPopAbr"
        self_test = disaggregate in ("Age/Sex/HIVSelfTest", "KeyPop/HIVSelfTest")
        if indicator is not None and not (indicator == "HTS_SELF" and self_test):
            listed.add((indicator, kind, disaggregate))
    fine = defaultdict(list)

    def add(country, indicator, disaggregate, year, source, values):
        place = country if profile.by_country else None
        fine[(place, indicator, disaggregate, year, source)].append(values)

    for row in results:
        unit, country, indicator, kind, disaggregate, year, targets, cumulative = row[:8]
        if unit != profile.operatingunit:
            continue
        if profile.countries and country not in profile.countries:
            continue
        if (indicator, kind, disaggregate) in listed:
            name = cleaned(indicator, kind)
            plain = name == "PrEP_NEW" and disaggregate == "KeyPopAbr"
            key = "KeyPop" if plain else disaggregate
            add(country, name, key, year, "results", (targets, cumulative))
        extra = profile.supplement
        if extra and (indicator, disaggregate) == (
            extra.indicator,
            extra.standardizeddisaggregate,
        ):
            if year is not None and year >= extra.first_year:
                name = cleaned(indicator, kind)
                add(country, name, disaggregate, year, "supplement", (targets, cumulative))
    for _, _, psnu, psnuuid, indicator, kind, disaggregate, year, targets, _ in plan:
        if year != profile.plan_year:
            continue
        site = None if psnu is None else psnu.replace("_Military", "", 1).strip()
        key = (profile.operatingunit, site, psnuuid)
        names = {name for unit, name, *rest in hierarchy if (unit, *rest) == key}
        country = names.pop() if names else None
        place = site if country is None else country
        add(place, cleaned(indicator, kind), disaggregate, year, "plan", (targets, None))

    cells = defaultdict(list)
    for (country, indicator, disaggregate, year, source), values in fine.items():
        if year is None or year < profile.first_year:
            continue
        if any(i == indicator and d == disaggregate for i, d in profile.exclusions):
            continue
        # A comparison with a missing value is neither true nor false, and such a row goes.
        if disaggregate is None and any(i == indicator for i, _ in profile.exclusions):
            continue
        if indicator is None and any(d == disaggregate for _, d in profile.exclusions):
            continue
        if indicator is None and disaggregate is None and profile.exclusions:
            continue
        if indicator in profile.excluded_indicators:
            continue
        general = disaggregate is not None and "Key" not in disaggregate
        ids = (country, indicator, "Age/Sex" if general else "KeyPop")
        sums = tuple(total(v[k] for v in values) for k in (0, 1))
        cells[(ids, year)].append(sums)

    rows = []
    for ids in {ids for ids, _ in cells}:
        by_year = {
            year: [sum(sums) for sums in zip(*cells[(ids, year)])]
            for year in profile.years
            if (ids, year) in cells
        }
        before, after = (by_year.get(year, [None])[0] for year in profile.years[-2:])
        if profile.drop_zero_and_absent and not before and after is None:
            continue  # a missing "before" makes the condition missing, and the row goes too
        diff = None if before is None or after is None else after - before
        change = divided(diff, before)
        shown = []
        for year in profile.years:
            sums = by_year.get(year, [None, None])
            with_results = len(profile.measures) == 2 and year != profile.plan_year
            shown += sums if with_results else sums[:1]
        if profile.change == "fraction":
            relative = rounded(change)
        else:
            relative = percent(None if change is None else change * 100)
        rows.append((*(ids if profile.by_country else ids[1:]), *shown, diff, relative))
    return rows


def comparable(rows):
    return sorted(tuple("NaN" if v != v else str(v) for v in row) for row in rows)


def made(rng, unit, profile):
    def one(options):
        return rng.choice(options)

    results = [
        fixtures.result(
            one([unit, unit, "Elsewhere", None]),
            one(COUNTRIES),
            one(INDICATORS),
            one(KINDS),
            one(DISAGGREGATES),
            one([2021, 2022, 2023, None]),
            one(VALUES),
            one(VALUES),
        )
        for _ in range(150)
    ]
    plan = [
        (unit, None, *one(SITES), one(INDICATORS), one(KINDS), one(DISAGGREGATES))
        + (one([2023, 2024, 2024]), one(VALUES), None)
        for _ in range(60)
    ]
    mapping = [(one(INDICATORS), one(KINDS), one(DISAGGREGATES)) for _ in range(60)]
    hierarchy = [
        (unit, "Jamaica", "Kingston", "k"),
        (unit, "Jamaica", "Kingston", "k"),
        (unit, None, "Port", "p"),
        (unit, "Haiti", "Lost", None),
        ("Elsewhere", "Other", "Port", "p"),
    ]
    return results, plan, mapping, hierarchy


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("name", sorted(PROFILES))
def test_random_tables(spark, name, seed):
    profile = replace(PROFILES[name], duplicates="sum")
    if profile.countries:
        profile = replace(profile, countries=PROFILES["caribbean"].countries)
    tables = made(random.Random(f"{name} {seed}"), profile.operatingunit, profile)
    schemas = (fixtures.RESULTS, fixtures.PLAN, fixtures.MAPPING, fixtures.HIERARCHY)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in zip(tables, schemas)]
    df = compare(*frames[:3], profile, frames[3])
    wanted = expected(*tables, profile)
    assert len(wanted) > 5
    assert comparable(df.collect()) == comparable(wanted)


def test_rounding_of_many_numbers(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(-999, 999) / 1.0, float(rng.randint(0, 400))) for _ in range(3000)]
    pairs += [(float(n), 1000.0) for n in range(-3000, 3000)]
    change = ratio(F.col("n"), F.col("d"))
    found = spark.createDataFrame(pairs, "n DOUBLE, d DOUBLE").select(
        "n", "d", round_half_even(change, 2).alias("x"), percent_text(F.rint(change)).alias("text")
    )
    wanted = [(n, d, rounded(divided(n, d)), percent(divided(n, d))) for n, d in pairs]
    wanted = [(n, d, 0.0 if x == 0 else x, text) for n, d, x, text in wanted]
    got = [(r.n, r.d, 0.0 if r.x == 0 else r.x, r.text) for r in found.collect()]
    assert comparable(got) == comparable(wanted)
