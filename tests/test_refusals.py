"""What is refused instead of lost: years without a column, and damaged lines of text."""

import os
from dataclasses import replace

import pytest

import fixtures
from plumbline import PROFILES, compare
from plumbline.operators import pivot_wider
from plumbline.plans.compare import change_names, shown_columns
from plumbline.plans.quality import unlisted_years
from plumbline.sources import latest_file, read_results

YEARLY = "id STRING, fy STRING, x DOUBLE"


def test_a_pivot_names_the_year_it_has_no_column_for(spark):
    df = spark.createDataFrame([("a", "FY23", 1.0), ("a", "FY25", 2.0), ("b", None, 3.0)], YEARLY)
    with pytest.raises(Exception, match="FY25 is not listed, for a|NULL is not listed, for b"):
        pivot_wider(df, ["id"], "fy", ["FY23"], ["x"]).collect()
    kept = pivot_wider(df, ["id"], "fy", ["FY23"], ["x"], unlisted="drop").collect()
    assert [tuple(r) for r in kept] == [("a", 1.0)]
    with pytest.raises(ValueError, match="unlisted"):
        pivot_wider(df, ["id"], "fy", ["FY23"], ["x"], unlisted="keep")


def test_a_later_year_stops_the_country_report_only_when_asked(spark):
    profile = PROFILES["dominican_republic"]
    tables = (fixtures.country_results(spark), fixtures.country_plan(spark), fixtures.mapping(spark))
    later = tables[0].where("fiscal_year = 2023").selectExpr(
        *[f"{c} + 2 AS {c}" if c == "fiscal_year" else c for c in tables[0].columns]
    )
    results = tables[0].unionByName(later)
    assert {r.fiscal_year for r in unlisted_years(results, tables[1], profile).collect()} == {2025}
    assert compare(results, *tables[1:], profile).count() == compare(*tables, profile).count()
    with pytest.raises(Exception, match="FY25 is not listed"):
        compare(results, *tables[1:], replace(profile, unlisted="error")).collect()


def test_the_compared_years_can_be_chosen():
    profile = replace(PROFILES["caribbean"], years=(2023, 2024, 2025), before=2023, after=2024)
    assert profile.compared == (2023, 2024)
    assert shown_columns(profile) == ["FY23", "FY24", "FY25"]
    wide = replace(PROFILES["dominican_republic"], before=2022, after=2023)
    assert change_names(wide)[0] == "targets_diff_fy_23_22"
    with pytest.raises(ValueError, match="among the years"):
        replace(PROFILES["caribbean"], before=2020)


HEADER = (
    "operatingunit\tindicator\tnumeratordenom\tstandardizeddisaggregate\tfiscal_year\ttargets\t"
    "funding_agency\tmech_code\n"
)
GOOD = "Region\tHTS_TST\tN\tAge/Sex\t2023\t12.5\tAgency\t00123\n"


@pytest.mark.parametrize(
    "line",
    [
        "Region\tHTS_TST\tN\tAge/Sex\t2023\n",
        GOOD.rstrip("\n") + "\textra\n",
        'Region\t"HTS_TST\tN\tAge/Sex\t2023\t12.5\tAgency\t00123\n',
    ],
)
@pytest.mark.parametrize("columns", [["*"], ["indicator"]])
def test_damaged_lines_stop_the_query(spark, tmp_path, line, columns):
    (tmp_path / "results.txt").write_text(HEADER + GOOD + line + GOOD)
    df = read_results(spark, str(tmp_path / "results.txt"), "tsv")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        df.select(*columns).collect()


def test_quotes_can_be_taken_as_they_stand(spark, tmp_path):
    (tmp_path / "results.txt").write_text(HEADER + GOOD.replace("HTS", '"HTS'))
    df = read_results(spark, str(tmp_path / "results.txt"), "tsv", quote="")
    assert df.first().indicator == '"HTS_TST'


def test_folders_that_do_not_match_are_not_looked_into(spark, tmp_path):
    for i in range(20):
        folder = tmp_path / f"other_{i}" / "deep"
        folder.mkdir(parents=True)
        (folder / "plan.txt").write_text("x")
    locked = tmp_path / "other_0"
    (tmp_path / "plan_1.txt").write_text("x")
    os.chmod(locked, 0)  # listing it would fail for most users
    try:
        assert latest_file(spark, str(tmp_path), "^plan").endswith("plan_1.txt")
    finally:
        os.chmod(locked, 0o755)
