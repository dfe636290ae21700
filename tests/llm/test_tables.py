"""Salted joins against plain ones, and the size that Spark expects of the rows that they repeat."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.llm.tables import SALTS, salted_join

KEYS = ["key", "kind"]


def both_sides(spark, keys):
    left = spark.range(600).select("id", (F.col("id") % 7).alias("key"), F.lit("x").alias("kind"))
    left = left.withColumn("key", F.when(F.col("key") > 0, F.col("key")))
    right = spark.range(keys).select(F.col("id").alias("key"), F.lit("x").alias("kind"), F.lit(1.5).alias("value"))
    return left, right.withColumn("key", F.when(F.col("key") > 0, F.col("key")))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_rows_are_those_of_a_plain_join(spark, how):
    left, right = both_sides(spark, 4)
    found = salted_join(left, right, KEYS, F.col("id"), how)
    assert found.columns == ["id", "key", "kind", "value"]
    names = {i: i % 7 if i % 7 else None for i in range(600)}
    want = {(i, k, "x", 1.5 if k is None or k < 4 else None) for i, k in names.items()}
    want = {row for row in want if how == "left" or row[3]}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize(("keys", "broadcast"), [(20_000, False), (20, True)])
def test_repeated_rows_are_broadcast_by_their_own_size(spark, keys, broadcast):
    left, right = both_sides(spark, keys)
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    name, limit = "spark.sql.autoBroadcastJoinThreshold", 20_000 * 40
    assert size < limit and (size * SALTS < limit) == broadcast
    before = spark.conf.get(name)
    spark.conf.set(name, limit)
    try:
        joined = salted_join(left, right, KEYS, F.col("id"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert ("BroadcastHashJoin" in plan) == broadcast
