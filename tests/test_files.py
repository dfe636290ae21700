"""Sources and sinks on temporary files."""

import os

import pytest
from py4j.protocol import Py4JJavaError

import fixtures
from plumbline import PROFILES, compare
from plumbline.__main__ import run
from plumbline.plans.report import section_table
from plumbline.sinks import save_report
from plumbline.sources import latest_file, read_hierarchy, read_mapping, read_plan, read_results


def made(path, text="x", age=0):
    path.write_text(text)
    os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    return path


def test_newest_matching_file(spark, tmp_path):
    made(tmp_path / "Reported_SITES_FY22.txt", age=500)
    newest = made(tmp_path / "Reported_SITES_FY23 (1).txt", age=100)
    made(tmp_path / "Reported_UNITS_FY23.txt")
    made(tmp_path / "Reported_SITES_empty.txt", text="")
    assert latest_file(spark, str(tmp_path), "SITES").endswith(newest.name)
    assert latest_file(spark, str(tmp_path), r"^Reported_.*FY22\.txt$").endswith("FY22.txt")
    with pytest.raises(FileNotFoundError, match="OTHER"):
        latest_file(spark, str(tmp_path), "OTHER")
    with pytest.raises(ValueError, match="absolute"):
        latest_file(spark, "data", "SITES")


def test_newest_dataset(spark, tmp_path):
    older, newer = tmp_path / "plan_a", tmp_path / "plan_b (final)"
    for age, folder in ((300, older), (50, newer)):
        (folder / "year=2024").mkdir(parents=True)
        made(folder / "year=2024" / "plan_part.parquet", age=age)
    made(tmp_path / "results.txt", age=0)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert latest_file(spark, folder, "^plan") == f"file:{newer}"
        assert latest_file(spark, folder, "part|a$") == f"file:{older}"


HEADER = (
    "country\toperatingunit\tsitename\tindicator\tnumeratordenom\tstandardizeddisaggregate\t"
    "fiscal_year\ttargets\tcumulative\tfunding_agency\tmech_code\tsource_name\n"
)
LINE = "Jamaica\tRegion\tClinic\tHTS_TST\tN\tAge/Sex\t2023\t12.5\tNA\tAgency\t00123\t\n"


def test_text_results_are_read_by_name(spark, tmp_path):
    made(tmp_path / "results.txt", HEADER + LINE)
    df = read_results(spark, str(tmp_path / "results.txt"), "tsv")
    row = df.first()
    assert dict(df.dtypes)["fiscal_year"] == "int" and dict(df.dtypes)["targets"] == "double"
    assert (row.fiscal_year, row.targets, row.cumulative) == (2023, 12.5, None)
    assert (row.mech_code, row.source_name, row.sitename) == ("00123", None, "Clinic")


def test_files_with_other_column_order_are_not_misread(spark, tmp_path):
    names, values = HEADER.split(), LINE.rstrip("\n").split("\t")
    made(tmp_path / "a.txt", HEADER + LINE * 3)
    turned = ["\t".join(reversed(row)) + "\n" for row in (names, values)]
    made(tmp_path / "b.txt", "".join(turned))
    with pytest.raises(Py4JJavaError, match="FAILED_READ_FILE"):
        read_results(spark, str(tmp_path), "tsv").select("country", "targets").collect()


def test_missing_input_column(spark, tmp_path):
    made(tmp_path / "plan.csv", "indicator,targets\nHTS_TST,1\n")
    with pytest.raises(ValueError, match="missing columns: operatingunit"):
        read_plan(spark, str(tmp_path / "plan.csv"), "csv")


def test_optional_columns_may_be_absent(spark, tmp_path):
    columns = "operatingunit,indicator,numeratordenom,standardizeddisaggregate,fiscal_year,targets"
    made(tmp_path / "plan.csv", f"{columns}\nRegion,HTS_TST,N,Age/Sex,2024,1\n")
    df = read_plan(spark, str(tmp_path / "plan.csv"), "csv")
    assert df.columns == columns.split(",") and df.first().fiscal_year == 2024


def test_archives_and_unknown_formats_are_refused(spark):
    with pytest.raises(ValueError, match="convert"):
        read_results(spark, "/data/results.zip", "tsv")
    with pytest.raises(ValueError, match="unknown format"):
        read_mapping(spark, "/data/mapping.avro", "avro")


def test_hierarchy_of_one_unit(spark, tmp_path):
    rows = [("A", "x", "s", "1", "uid1"), ("B", "y", "t", "2", "uid2")]
    schema = f"{fixtures.HIERARCHY}, operatingunituid STRING"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sites")
    assert read_hierarchy(spark, f"{tmp_path}/sites").count() == 2
    one = read_hierarchy(spark, f"{tmp_path}/sites", ou_uid="uid2")
    assert [row.countryname for row in one.collect()] == ["y"]


@pytest.fixture
def stored(spark, tmp_path):
    """The country tables as Parquet, results partitioned by year."""
    paths = {name: f"{tmp_path}/{name}" for name in ("results", "plan", "mapping")}
    fixtures.country_results(spark).write.partitionBy("fiscal_year").parquet(paths["results"])
    fixtures.country_plan(spark).write.parquet(paths["plan"])
    fixtures.mapping(spark).write.orc(paths["mapping"])
    return (
        read_results(spark, paths["results"]),
        read_plan(spark, paths["plan"]),
        read_mapping(spark, paths["mapping"], "orc"),
    )


@pytest.mark.parametrize("table_format", ["csv", "parquet", "json"])
def test_saved_report(spark, stored, tmp_path, table_format):
    profile = PROFILES["dominican_republic"]
    comparison = compare(*stored, profile)
    paths = save_report(comparison, profile, f"{tmp_path}/report", table_format)
    assert set(paths) == {"data", "all", "key"}
    assert spark.read.parquet(paths["data"]).count() == 7
    for name in ("all", "key"):
        expected = section_table(comparison, profile, name)
        table = spark.read.schema(expected.schema).option("header", True)
        written = table.format(table_format).load(paths[name])
        assert sorted(map(str, written.collect())) == sorted(map(str, expected.collect()))


def test_command_line(spark, stored, tmp_path):
    """The same reports as from Python, with the newest of the stored tables."""
    common = ["--results", f"{tmp_path}/results", "--input-format", "parquet"]
    tables = ["--plan", str(tmp_path), "--plan-pattern", "^plan$"]
    tables += ["--mapping", f"{tmp_path}/triples"]
    fixtures.mapping(spark).write.parquet(f"{tmp_path}/triples")
    run(spark, ["dominican_republic", *common, *tables, "--output", f"{tmp_path}/report"])
    found = spark.read.option("header", True).csv(f"{tmp_path}/report/dominican_republic/all")
    assert found.count() == 6 and "targets change_FY24_23" in found.columns
    run(spark, ["completeness", *common, "--output", f"{tmp_path}/check", "--format", "json"])
    assert os.path.exists(f"{tmp_path}/check/completeness/_SUCCESS")
    years = ["absent_years", *common, *tables, "--profile", "dominican_republic"]
    run(spark, [*years, "--output", f"{tmp_path}/check"])
    assert os.path.exists(f"{tmp_path}/check/completeness/_SUCCESS")
    wrong_names = (["caribbean_by_country", *tables], ["caribbean"], ["unlisted_years", *tables])
    for wrong in wrong_names:
        with pytest.raises(SystemExit):
            run(spark, [*wrong, *common, "--output", f"{tmp_path}/none"])


def test_saving_again_overwrites(spark, stored, tmp_path):
    profile = PROFILES["dominican_republic"]
    for _ in range(2):
        paths = save_report(compare(*stored, profile), profile, f"{tmp_path}/report/")
    assert spark.read.parquet(paths["data"]).count() == 7
