"""Tables that grow or are damaged: newest of many files, quarantine, kept sums, published versions."""

import os
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import fixtures
from plumbline import PROFILES, compare
from plumbline.operators import names_in, pivot_wider, stored
from plumbline.operators.storage import shared_folder
from plumbline.plans.quality import disagg_completeness
from plumbline.sinks import publish_report, published_report
from plumbline.sinks import report as report_module
from plumbline.sources import fold_in, latest_file, read_results, read_summaries, read_with_quarantine
from plumbline.sources import summaries as summaries_module
from plumbline.sources.tables import MAPPING


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_newest_of_folders_with_many_parts(spark, tmp_path):
    """Several matches, subfolders beyond what the driver lists by itself, hidden and empty files."""
    base = 1_700_000_000
    for n, folder in enumerate(["SITES a", "SITES [b]", "SITES_c", "OTHER"]):
        for part in range(40):
            inside = tmp_path / folder / f"day={part}"
            inside.mkdir(parents=True)
            (inside / "part.parquet").write_text("x")
            age = 0 if (n, part) == (1, 17) else 1000 + n
            os.utime(inside / "part.parquet", (base - age, base - age))
    hidden, empty = tmp_path / "SITES_c" / "_new", tmp_path / "SITES_c" / "new"
    hidden.write_text("x")
    empty.write_text("")
    assert latest_file(spark, str(tmp_path), "SITES") == f"file:{tmp_path}/SITES [b]"
    assert latest_file(spark, str(tmp_path), "SITES.[ac]") == f"file:{tmp_path}/SITES a"
    (tmp_path / "SITES_file").write_text("x")
    assert latest_file(spark, str(tmp_path), "SITES") == f"file:{tmp_path}/SITES_file"
    (tmp_path / "NONE_folder" / "deep").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        latest_file(spark, str(tmp_path), "NONE")


HEADER = "indicator\tnumeratordenom\tstandardizeddisaggregate"
LINES = {
    "a\tN\tAge": None,
    "NA\t\tAge": None,
    '"q\tq"\tN\tx': None,
    "a\tN": "too few fields",
    "": "skipped",
    "a\tN\tAge\textra": "too many fields",
    'a\t"N\tAge': "open quote",
    'a\tN\t"Age': "open quote",
}


def test_damaged_lines_go_to_quarantine(spark, tmp_path):
    for name in ("one.txt", "two.txt"):
        (tmp_path / name).write_text("\n".join([HEADER, *LINES]) + "\n")
    good, bad = read_with_quarantine(spark, str(tmp_path), "tsv", MAPPING)
    kept = sorted(map(tuple, good.collect()), key=str)
    assert kept == sorted([("a", "N", "Age"), (None, None, "Age"), ("q\tq", "N", "x")] * 2, key=str)
    found = bad.collect()
    want = [(line, reason) for line, reason in LINES.items() if reason not in (None, "skipped")] * 2
    assert sorted((r.line, r.reason) for r in found) == sorted(want)
    assert {r.file.rpartition("/")[2] for r in found} == {"one.txt", "two.txt"}
    assert len(kept) + len(found) == 2 * (len(LINES) - 1)


def test_quarantine_without_quotes_and_refusals(spark, tmp_path):
    (tmp_path / "m.csv").write_text('indicator,numeratordenom,standardizeddisaggregate\n"a,N,x\na,N\n')
    good, bad = read_with_quarantine(spark, str(tmp_path / "m.csv"), "csv", MAPPING, quote="")
    assert [tuple(r) for r in good.collect()] == [('"a', "N", "x")]
    assert [(r.line, r.reason) for r in bad.collect()] == [("a,N", "too few fields")]
    with pytest.raises(ValueError, match="only text"):
        read_with_quarantine(spark, str(tmp_path), "parquet", MAPPING)
    with pytest.raises(ValueError, match="convert"):
        read_with_quarantine(spark, "/data/m.zip", "csv", MAPPING)
    (tmp_path / "n.csv").write_text("numeratordenom,indicator,standardizeddisaggregate\nN,a,x\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        read_with_quarantine(spark, str(tmp_path), "csv", MAPPING).good.collect()


def test_sums_grow_file_by_file(spark, tmp_path):
    rows = fixtures.country_results(spark)
    folder, store = f"{tmp_path}/results", f"{tmp_path}/sums"
    rows.where("fiscal_year < 2023").repartition(3).write.parquet(folder)
    assert len(fold_in(spark, store, [folder])) > 0 and fold_in(spark, store, [folder]) == []
    rows.where("fiscal_year >= 2023").coalesce(1).write.mode("append").parquet(folder)
    assert len(fold_in(spark, store, [folder])) == 1
    profile = PROFILES["dominican_republic"]
    others = fixtures.country_plan(spark), fixtures.mapping(spark)
    sums = read_summaries(spark, store)
    assert rows_of(compare(sums, *others, profile)) == rows_of(compare(rows, *others, profile))
    assert rows_of(disagg_completeness(sums)) == rows_of(disagg_completeness(rows))
    # A file that changes replaces its own sums.
    path = next(p for p in (tmp_path / "results").glob("*.parquet") if read_results(spark, str(p)).count())
    read_results(spark, str(path)).withColumn("targets", F.col("targets") * 2).coalesce(1).write.parquet(
        f"{tmp_path}/other"
    )
    new = next((tmp_path / "other").glob("*.parquet"))
    path.write_bytes(new.read_bytes())
    os.utime(path, (2_000_000_000, 2_000_000_000))
    (tmp_path / "results" / f".{path.name}.crc").unlink(missing_ok=True)
    assert len(fold_in(spark, store, [folder])) == 1
    again = compare(read_summaries(spark, store), *others, profile)
    assert rows_of(again) == rows_of(compare(read_results(spark, folder), *others, profile))


def test_only_new_files_are_opened(spark, tmp_path):
    rows = fixtures.country_results(spark)
    folder, store = f"{tmp_path}/results", f"{tmp_path}/sums"
    rows.coalesce(1).write.parquet(folder)
    fold_in(spark, store, [folder])
    rows.coalesce(1).write.mode("append").parquet(folder)
    new = fold_in(spark, store, [folder])
    table = summaries_module._named(read_results(spark, folder))
    scan = table.where(F.col("file").isin(new))
    assert len(new) == 1 and scan.rdd.getNumPartitions() == 1
    with pytest.raises(FileNotFoundError):
        read_summaries(spark, f"{tmp_path}/none")


def test_a_stopped_publication_leaves_the_old_report(spark, tmp_path, monkeypatch):
    profile = PROFILES["dominican_republic"]
    tables = fixtures.country_results(spark), fixtures.country_plan(spark), fixtures.mapping(spark)
    folder = f"{tmp_path}/report"
    with pytest.raises(FileNotFoundError):
        published_report(spark, folder)
    first = publish_report(compare(*tables, profile), profile, folder, "parquet")
    assert published_report(spark, folder) == first
    before = {name: rows_of(spark.read.parquet(path)) for name, path in first.items()}
    save, calls = report_module.save_table, []

    def stops(table, path, table_format):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        save(table, path, table_format)

    monkeypatch.setattr(report_module, "save_table", stops)
    with pytest.raises(RuntimeError, match="lost"):
        publish_report(compare(*tables, profile).limit(1), profile, folder, "parquet")
    monkeypatch.undo()
    assert published_report(spark, folder) == first
    assert {name: rows_of(spark.read.parquet(path)) for name, path in first.items()} == before
    second = publish_report(compare(*tables, profile).limit(2), profile, folder, "parquet")
    third = publish_report(compare(*tables, profile).limit(3), profile, folder, "parquet")
    assert published_report(spark, folder) == third
    assert spark.read.parquet(third["data"]).count() >= spark.read.parquet(second["data"]).count() > 0
    assert not os.path.exists(first["data"].removeprefix("file:"))


def test_pivot_finds_its_names(spark):
    df = spark.createDataFrame([("a", "FY25", 1.0), ("a", "FY23", 2.0), ("b", "FY24", 3.0)], "id STRING, fy STRING, x DOUBLE")
    wide = pivot_wider(df, ["id"], "fy", None, ["x"])
    assert wide.columns == ["id", "FY23", "FY24", "FY25"]
    assert set(map(tuple, wide.collect())) == {("a", 2.0, None, 1.0), ("b", None, 3.0, None)}
    summed = pivot_wider(df.union(df), ["id"], "fy", None, ["x"], duplicates="sum")
    assert set(map(tuple, summed.collect())) == {("a", 4.0, None, 2.0), ("b", None, 6.0, None)}
    with pytest.raises(Exception, match="more than one x in FY2. for"):
        pivot_wider(df.union(df), ["id"], "fy", None, ["x"]).collect()
    with pytest.raises(ValueError, match="more than 2 names"):
        pivot_wider(df, ["id"], "fy", None, ["x"], most_names=2)
    with pytest.raises(ValueError, match="missing"):
        names_in(df.selectExpr("id", "nullif(fy, 'FY24') AS fy"), "fy")
    empty = pivot_wider(df.where("false"), ["id"], "fy", None, ["x"])
    assert empty.columns == ["id"] and empty.count() == 0


def test_other_years_get_columns(spark):
    profile = replace(PROFILES["dominican_republic"], unlisted="column")
    tables = (fixtures.country_results(spark), fixtures.country_plan(spark), fixtures.mapping(spark))
    later = tables[0].where("fiscal_year = 2023").withColumn("fiscal_year", F.lit(2025))
    plain = compare(*tables, profile)
    assert plain.columns == compare(*tables, PROFILES["dominican_republic"]).columns
    wide = compare(tables[0].unionByName(later), *tables[1:], profile)
    added = [c for c in wide.columns if c not in plain.columns]
    assert added == ["targets_FY25", "cumulative_FY25"]
    assert wide.where("targets_FY25 = targets_FY23").count() > 0


def test_a_stored_table_needs_a_shared_folder_on_a_cluster(tmp_path):
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("hdfs://x/y/", "spark://x")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "spark://x"))
    own = shared_folder(session(None, "local[2]"))
    assert os.path.isdir(own) and shared_folder(session(None, "local[2]")) == own


def test_a_stored_table_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, 2.5)], "a INT, b STRING, c DOUBLE")
    again = stored(df, "x")
    assert again.schema == df.schema and again.collect() == df.collect()
