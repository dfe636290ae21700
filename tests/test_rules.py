"""One test per rule where plain Spark gives another answer."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.functions import (
    drop_nan,
    fiscal_label,
    format_integer,
    format_percent,
    is_in,
    is_missing,
    na_sum,
    not_in,
    percent_text,
    ratio,
    remove_first,
    replace_first,
    round_half_even,
    trim_whitespace,
    year_name,
)
from plumbline.operators import (
    absent_after_zero,
    bind_rows,
    derive,
    drop_columns,
    exclude_pairs,
    exclude_within,
    in_year,
    left_join,
    order_rows,
    pivot_wider,
    relocate,
    rename,
    select_any_of,
    semi_join,
    sum_by,
    union_strict,
    unique_lookup,
    unpivot_years,
)

NAN, INF = math.nan, math.inf


def column(df, expression):
    rows = df.select(expression.alias("x")).collect()
    return ["NaN" if isinstance(r.x, float) and math.isnan(r.x) else r.x for r in rows]


def numbers(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE")


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x STRING")


def test_sum_of_missing_values_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "k STRING, x DOUBLE")
    assert sorted(map(tuple, sum_by(df, ["k"], ["x"]).collect())) == [("a", 0.0), ("b", 2.0)]


def test_sum_ignores_nan(spark):
    assert numbers(spark, 1.0, NAN, None).agg(na_sum(F.col("x")).alias("s")).first().s == 1.0


def test_sum_of_integers(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x INT")
    assert df.agg(na_sum(F.col("x")).alias("s")).first().s == 4.0


def test_missing_number(spark):
    df = numbers(spark, 1.0, NAN, None)
    assert column(df, is_missing(F.col("x"))) == [False, True, True]
    assert column(df, drop_nan(F.col("x"))) == [1.0, None, None]


def test_excluded_pair_drops_missing_member_of_listed_indicator(spark):
    rows = [("A", "x"), ("A", None), ("A", "y"), ("B", "x"), ("B", None), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "i STRING, d STRING")
    kept = df.where(exclude_pairs(F.col("i"), F.col("d"), [("A", "x"), ("C", "x")]))
    assert set(map(tuple, kept.collect())) == {("A", "y"), ("B", "x"), ("B", None), (None, "y")}
    assert df.where(exclude_pairs(F.col("i"), F.col("d"), [])).count() == len(rows)


def test_exclusion_equals_one_condition_per_pair(spark):
    values = ["A", "B", "C", None]
    df = spark.createDataFrame([(i, d) for i in values for d in values], "i STRING, d STRING")
    pairs = [("A", "B"), ("B", "B"), ("A", "C"), ("C", "A")]
    one_by_one = df
    for i, d in pairs:
        one_by_one = one_by_one.where(~((F.col("i") == i) & (F.col("d") == d)))
    together = df.where(exclude_pairs(F.col("i"), F.col("d"), pairs))
    assert sorted(map(str, together.collect())) == sorted(map(str, one_by_one.collect()))


def test_membership_of_missing_value(spark):
    df = texts(spark, "a", "b", None)
    assert column(df, is_in(F.col("x"), ["a"])) == [True, False, False]
    assert column(df, not_in(F.col("x"), ["a"])) == [False, True, True]


def test_guarded_exclusion(spark):
    rows = [("S", "x"), ("S", "y"), ("S", None), ("T", "x"), (None, "y")]
    df = spark.createDataFrame(rows, "g STRING, m STRING")
    kept = df.where(exclude_within(F.col("g"), "S", F.col("m"), ["x"])).collect()
    assert set(map(tuple, kept)) == {("S", "y"), ("S", None), ("T", "x")}


def test_zero_and_absent(spark):
    rows = [(0.0, None), (0.0, NAN), (0.0, 1.0), (2.0, None), (None, 3.0), (None, None)]
    df = spark.createDataFrame(rows, "b DOUBLE, a DOUBLE")
    kept = df.where(~absent_after_zero(F.col("b"), F.col("a"))).collect()
    assert set(map(tuple, kept)) == {(0.0, 1.0), (2.0, None), (None, 3.0)}


def test_joins_match_missing_keys(spark):
    keys = "k STRING, l STRING"
    left_rows = [("a", None, 1), ("a", "x", 2), (None, None, 3)]
    left = spark.createDataFrame(left_rows, f"{keys}, v INT")
    right = spark.createDataFrame([("a", None, "p"), (None, None, "q")], f"{keys}, w STRING")
    joined = left_join(left, right, ["k", "l"])
    assert joined.columns == ["k", "l", "v", "w"]
    assert sorted((r.v, r.w) for r in joined.collect()) == [(1, "p"), (2, None), (3, "q")]
    assert sorted(r.v for r in semi_join(left, right, ["k", "l"]).collect()) == [1, 3]


def test_left_join_refuses_shared_columns_and_missing_keys(spark):
    df = spark.createDataFrame([("a", 1)], "k STRING, v INT")
    with pytest.raises(ValueError, match="both sides: v"):
        left_join(df, df, ["k"])
    with pytest.raises(ValueError, match="missing columns: z"):
        semi_join(df, df, ["z"])


def test_lookup_with_two_values_stops(spark):
    rows = [("k", "A"), ("k", "A"), ("m", None)]
    schema = "key STRING, value STRING"
    good = spark.createDataFrame(rows, schema)
    assert set(map(tuple, unique_lookup(good, ["key"], "value").collect())) == {
        ("k", "A"),
        ("m", None),
    }
    for extra in (("k", "B"), ("k", None)):
        bad = spark.createDataFrame([*rows, extra], schema)
        with pytest.raises(PySparkException, match="more than one value for k"):
            unique_lookup(bad, ["key"], "value").collect()
        assert unique_lookup(bad, ["key"], "value", duplicates="keep").count() == 3


def test_bind_rows_fills_and_checks_types(spark):
    top = spark.createDataFrame([("a", 1.0, 2.0)], "k STRING, x DOUBLE, y DOUBLE")
    bottom = spark.createDataFrame([(3, "b")], "x INT, k STRING")
    assert set(map(tuple, bind_rows(top, bottom).collect())) == {("a", 1.0, 2.0), ("b", 3.0, None)}
    with pytest.raises(TypeError, match="column x: double and string"):
        bind_rows(top, spark.createDataFrame([("1",)], "x STRING"))


def test_union_strict_needs_same_columns(spark):
    one = spark.createDataFrame([(1, 2)], "a INT, b INT")
    other = spark.createDataFrame([(4, 3)], "b INT, a INT")
    assert set(map(tuple, union_strict(one, other).collect())) == {(1, 2), (3, 4)}
    with pytest.raises(ValueError, match="one side only: b"):
        union_strict(one, other.drop("b"))


def test_rounding_to_two_digits(spark):
    df = numbers(spark, 0.125, 0.375, 2.675, -0.125, -2.675, 0.1 + 0.2, 1e300, INF, -INF, NAN, None)
    assert column(df, round_half_even(F.col("x"), 2)) == [
        0.12, 0.38, 2.67, -0.12, -2.67, 0.3, 1e300, INF, -INF, "NaN", None,
    ]


def test_rounding_to_whole(spark):
    df = numbers(spark, 0.5, 1.5, 2.5, -0.5, -1.5)
    assert column(df, round_half_even(F.col("x"))) == [0.0, 2.0, 2.0, 0.0, -2.0]


def test_ratio(spark):
    rows = [(6.0, 4.0), (5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (1.0, None), (None, 0.0), (NAN, 0.0)]
    df = spark.createDataFrame(rows, "n DOUBLE, d DOUBLE")
    assert column(df, ratio(F.col("n"), F.col("d"))) == [1.5, INF, -INF, "NaN", None, None, "NaN"]


def test_percent_text(spark):
    df = numbers(spark, -20.0, 25.0, -0.0, 100000.0, INF, -INF, NAN, None, 1e20)
    assert column(df, percent_text(F.col("x"))) == [
        "-20%", "25%", "0%", "100000%", "Inf%", "-Inf%", None, None, "1.0E20%",
    ]


def test_number_formats(spark):
    df = numbers(spark, 1234567.0, 2.5, 3.5, -0.3, -1234.0, INF, NAN, None)
    assert column(df, format_integer(F.col("x"))) == [
        "1,234,567", "2", "4", "0", "-1,234", "Inf", None, None,
    ]
    fractions = numbers(spark, 0.18, 0.12, -0.2, 12.5, INF, NAN, None)
    assert column(fractions, format_percent(F.col("x"))) == [
        "18%", "12%", "-20%", "1,250%", "Inf%", None, None,
    ]


def test_only_first_match_changes(spark):
    df = texts(spark, "2020", "a_Military_Military", "none", None, "20")
    assert column(df, replace_first(F.col("x"), "20", "FY")) == [
        "FY20", "a_Military_Military", "none", None, "FY",
    ]
    assert column(df, remove_first(F.col("x"), "_Military")) == [
        "2020", "a_Military", "none", None, "20",
    ]
    special = texts(spark, r"a.b$1\E")
    assert column(special, replace_first(F.col("x"), ".b", r"$0\1")) == [r"a$0\1$1\E"]


def test_trim_takes_all_whitespace(spark):
    df = texts(spark, "\t a b \n", "  x　", "", None)
    assert column(df, trim_whitespace(F.col("x"))) == ["a b", "x", "", None]


def test_fiscal_label(spark):
    df = spark.createDataFrame([(2023,), (2020,), (None,)], "y INT")
    assert column(df, fiscal_label(F.col("y"))) == ["FY23", "FY20", None]
    assert [year_name(2023), year_name(2020)] == ["FY23", "FY20"]


def test_year_given_as_text(spark):
    df = spark.createDataFrame([(2022,), (2023,)], "y INT")
    assert [r.y for r in df.where(in_year(F.col("y"), "2023")).collect()] == [2023]


def test_tolerant_select(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b INT, a INT, c INT")
    assert select_any_of(df, ["a", "A", "z", "a", "b"], must=["c", "a"]).columns == ["a", "b", "c"]
    with pytest.raises(ValueError, match="missing columns: m"):
        select_any_of(df, ["a"], must=["m"])


def test_strict_column_changes(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert drop_columns(df, "a").columns == ["b"]
    assert rename(df, c="a").columns == ["c", "b"]
    for change in (lambda: drop_columns(df, "z"), lambda: rename(df, y="z")):
        with pytest.raises(ValueError, match="missing columns: z"):
            change()
    later = derive(df, {"c": F.col("a") + 1, "a": F.col("c") * 10})
    assert tuple(later.first()) == (20, 2, 2)


def test_relocate(spark):
    by_country = spark.createDataFrame(
        [(1,) * 5], "country INT, indicator INT, kind INT, FY24 INT, FY23 INT"
    )
    assert relocate(by_country, "FY23", after=3).columns[3:] == ["FY23", "FY24"]
    regional = by_country.drop("country")
    assert relocate(regional, "FY23", after=3).columns[2:] == ["FY24", "FY23"]
    ordered = regional.select("indicator", "kind", "FY23", "FY24")
    assert relocate(ordered, "FY23", after=3).columns == ordered.columns


def test_pivot_refuses_duplicates(spark):
    rows = [("a", "FY23", 1.0), ("a", "FY23", 2.0), ("b", "FY24", 3.0)]
    df = spark.createDataFrame(rows, "id STRING, fy STRING, x DOUBLE")
    with pytest.raises(PySparkException, match="more than one x in FY23 for a"):
        pivot_wider(df, ["id"], "fy", ["FY23", "FY24"], ["x"]).collect()
    summed = pivot_wider(df, ["id"], "fy", ["FY23", "FY24"], ["x"], duplicates="sum")
    assert set(map(tuple, summed.collect())) == {("a", 3.0, None), ("b", None, 3.0)}
    with pytest.raises(ValueError, match="unknown duplicates rule"):
        pivot_wider(df, ["id"], "fy", ["FY23"], ["x"], duplicates="first")


def test_pivot_tells_absent_from_all_missing(spark):
    schema = "id STRING, fy STRING, x DOUBLE, y DOUBLE"
    df = spark.createDataFrame([("a", "FY23", None, 1.0)], schema)
    wide = pivot_wider(df, ["id"], "fy", ["FY23", "FY24"], ["x", "y"], duplicates="sum")
    assert wide.first().asDict() == {
        "id": "a", "x_FY23": 0.0, "x_FY24": None, "y_FY23": 1.0, "y_FY24": None,
    }


def test_unpivot_years(spark):
    schema = "id STRING, `2023 plan` DOUBLE, `2024 plan` DOUBLE"
    wide = spark.createDataFrame([("a", 1.0, None)], schema)
    years = {"2023 plan": 2023, "2024 plan": 2024}
    long = unpivot_years(wide, years)
    assert long.schema["fiscal_year"].dataType.simpleString() == "int"
    assert set(map(tuple, long.collect())) == {("a", 2023, 1.0), ("a", 2024, None)}
    assert unpivot_years(wide, years, drop_missing=True).count() == 1


def test_order_puts_missing_last_and_capitals_first(spark):
    df = texts(spark, "b", None, "B", "a")
    assert [r.x for r in order_rows(df, "x").collect()] == ["B", "a", "b", None]
