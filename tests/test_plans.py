"""Physical plans: what is read, what is broadcast, what is shuffled."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import fixtures
from __spark_entry__ import SMOKE_DIR
from catalog.queries import QUERIES
from plumbline import PROFILES, compare
from plumbline.operators import left_join, lookup_join, pivot_wider
from plumbline.plans import indicators, quality
from plumbline.plans.report import both_sections
from plumbline.sources import read_hierarchy, read_mapping, read_plan, read_results


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, table):
    return [line for line in plan.splitlines() if "FileScan" in line and f"/{table}]" in line]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    folder = tmp_path_factory.mktemp("tables")
    made = {
        "results": fixtures.regional_results(spark).union(fixtures.country_results(spark)),
        "plan": fixtures.regional_plan(spark),
        "mapping": fixtures.mapping(spark),
        "hierarchy": fixtures.hierarchy(spark),
    }
    for name, df in made.items():
        keys = ["fiscal_year"] if name == "results" else []
        df.write.partitionBy(*keys).parquet(f"{folder}/{name}")
    return {
        "results": read_results(spark, f"{folder}/results"),
        "plan": read_plan(spark, f"{folder}/plan"),
        "mapping": read_mapping(spark, f"{folder}/mapping"),
        "hierarchy": read_hierarchy(spark, f"{folder}/hierarchy"),
    }


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_each_table_is_read_once_and_pruned(tables, name):
    plan = executed(compare(**tables, profile=PROFILES[name]))
    results = scans(plan, "results")
    assert len(results) == 1 and len(scans(plan, "plan")) == 1 and len(scans(plan, "mapping")) == 1
    assert "funding_agency" not in results[0] and "source_name" not in results[0]
    first_year = PROFILES[name].first_year
    assert re.search(rf"PartitionFilters: \[[^]]*fiscal_year#\d+ >= {first_year}", results[0])
    assert "EqualTo(operatingunit," in results[0]
    assert "EqualTo(fiscal_year,2024)" in scans(plan, "plan")[0]


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_no_python_and_no_cartesian_product(tables, name):
    plan = executed(compare(**tables, profile=PROFILES[name]))
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"):
        assert word not in plan
    joins = 2 if PROFILES[name].by_country else 1
    assert len(re.findall(r"(?:BroadcastHash|SortMerge|ShuffledHash)Join", plan)) == joins


def sums_below_mapping_join(plan):
    """Aggregates between the join with the mapping and the scan of the results."""
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "/results]" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if re.search(r"Join\b", line))
    return len([line for line in lines[join:scan] if "HashAggregate" in line])


@pytest.mark.parametrize("name", sorted(PROFILES))
def test_the_mapping_meets_only_sums(tables, name):
    assert sums_below_mapping_join(executed(compare(**tables, profile=PROFILES[name]))) == 2


def test_a_large_mapping_meets_only_sums(tables, no_broadcast):
    plan = executed(compare(**tables, profile=PROFILES["caribbean"]))
    assert "Broadcast" not in plan and sums_below_mapping_join(plan) == 2


def test_same_answers_without_broadcast(tables, no_broadcast):
    df = compare(**tables, profile=PROFILES["caribbean_by_country"])
    assert df.count() == 4 and "Broadcast" not in executed(df)


def test_checks_and_sections_read_results_once(tables):
    assert len(scans(executed(quality.disagg_completeness(tables["results"])), "results")) == 1
    comparison = compare(**tables, profile=PROFILES["caribbean"])
    assert len(scans(executed(both_sections(comparison)), "results")) == 1


def test_sites_meet_only_sums_at_every_size(tables, spark):
    def plan_and_rows():
        planned = indicators.aggregate_plan_by_country(
            tables["plan"], tables["hierarchy"], 2024, fixtures.REGION
        )
        lines = executed(planned).splitlines()
        join = next(i for i, line in enumerate(lines) if "LeftOuter" in line)
        scan = next(i for i, line in enumerate(lines) if "/plan]" in line)
        sums = len([line for line in lines[join:scan] if "HashAggregate" in line])
        return lines[join], sums, sorted(map(tuple, planned.collect()))

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    join, sums, found = plan_and_rows()
    assert "BroadcastHashJoin" in join and sums == 2
    spark.conf.set(key, -1)
    join, sums, again = plan_and_rows()
    spark.conf.set(key, before)
    assert "SortMergeJoin" in join and sums == 2 and again == found


def test_building_a_plan_by_country_runs_no_job(tables, spark):
    spark.sparkContext.setJobGroup("built", "")
    indicators.assign_country(tables["plan"], tables["hierarchy"], fixtures.REGION)
    compare(**tables, profile=PROFILES["caribbean_by_country"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("", "")


def test_star_views_read_what_a_query_uses(spark):
    if not Path(SMOKE_DIR).exists():
        pytest.skip("the given tables are not here")
    plan = executed(QUERIES["compare_caribbean"](spark, SMOKE_DIR))
    lines = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert len(lines) == 2
    assert any("LessThan(l_shipdate,1998-01-01T00:00)" in line for line in lines)
    assert any("GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in line for line in lines)
    assert not any("l_suppkey" in line or "l_linenumber" in line for line in lines)
    plan = executed(QUERIES["disagg_completeness"](spark, SMOKE_DIR))
    assert "customer.parquet" not in plan and "nation.parquet" not in plan


def rows_of_tasks(joined):
    return sorted(n for n in joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n)


def test_a_hot_key_is_dealt_over_tasks(spark, no_broadcast):
    """One site with nine tenths of the rows, no broadcast and no splitting by adaptive execution."""
    hot = F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    left = spark.range(20000).select(hot.alias("site"), F.col("id").alias("x"), F.lit("y").alias("part"))
    lookup = left.select("site").distinct().withColumn("country", F.concat(F.lit("c"), "site"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(left, lookup, ["site"])
        assert joined.columns == ["site", "x", "part", "country"]
        assert max(rows_of_tasks(joined)) < 9000
        assert max(rows_of_tasks(left_join(left, lookup, ["site"]))) >= 18000
        assert joined.where("country = concat('c', site)").count() == 20000
        semi = lookup_join(left, lookup.where("site = 'hot'"), ["site"], "left_semi")
        assert semi.columns == left.columns and semi.count() == 18000 and max(rows_of_tasks(semi)) < 9000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_lookup_matches_missing_keys_and_repeats(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("b", 3)], "k STRING, v INT")
    right = spark.createDataFrame([("a", "x"), (None, "y")], "k STRING, w STRING")
    found = sorted(map(tuple, lookup_join(left, right, ["k"]).collect()), key=str)
    assert found == [("a", 1, "x"), ("a", 1, "x"), ("b", 3, None), (None, 2, "y")]
    assert lookup_join(left, right, ["k"], "left_semi").count() == 3
    with pytest.raises(ValueError, match="columns on both sides: v"):
        lookup_join(left, right.withColumn("v", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="unknown kind"):
        lookup_join(left, right, ["k"], "inner")


def test_summed_pivot_has_a_narrow_and_a_wide_aggregate(spark):
    """Raw rows meet one sum per measure; the many columns see one row for each id and name."""
    rows = spark.createDataFrame([("a", 2020 + i % 5, 1.0, 2.0) for i in range(50)], "k STRING, y INT, m DOUBLE, n DOUBLE")
    wide = pivot_wider(rows, ["k"], "y", range(2020, 2025), ["m", "n"], duplicates="sum")
    sums = [line for line in executed(wide).splitlines() if "HashAggregate" in line]
    assert len(sums) == 4
    assert len(re.findall("partial_sum", sums[-1])) == 2 and "partial_max" not in sums[-1]
    assert [tuple(r) for r in wide.collect()] == [("a", *[10.0] * 5, *[20.0] * 5)]
