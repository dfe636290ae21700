"""Sums of result files, kept so that a growing table is not read again.

Every report and check sums results by raw names, year and place before anything else. A store keeps these
sums for each file, and takes in new or changed files alone. What it returns has the columns of
results, so that reports and checks run on it as they do on the rows, over far fewer of them.

A batch of files is written aside and then renamed into the store: it is there whole or not at all, and a
stopped run can be repeated. Sums of doubles are added in another order than over all rows at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import sum_by
from plumbline.sources.tables import RESULTS, read_results

FILE = ("file", "modified")
MEASURES = ("targets", "cumulative")
# What reports and checks tell rows apart by; the other columns of results are only required to exist.
KEYS = (
    "operatingunit",
    "country",
    "indicator",
    "numeratordenom",
    "standardizeddisaggregate",
    "source_name",
    "fiscal_year",
)
STORED = "file STRING, modified TIMESTAMP, " + ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in RESULTS if f.name in (*KEYS, *MEASURES)
)

Reader = Callable[[SparkSession, str], DataFrame]


def fold_in(
    spark: SparkSession, store: str, paths: Sequence[str], reader: Reader = read_results
) -> list[str]:
    """Adds the sums of the files below ``paths`` that the store does not have yet, or has as they were
    before they changed. Returns these files. ``reader`` reads each path as results.
    """
    store = store.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    files = listed.select(*_file_columns())
    known = stored_sums(spark, store)
    if known is not None:
        files = files.join(known.select(*FILE).distinct(), list(FILE), "left_anti")
    new = sorted(row.file for row in files.collect())
    if not new:
        return []
    rows = [_named(reader(spark, path)) for path in paths]
    if known is not None:  # the condition is on files, so that only these are opened
        rows = [table.where(F.col("file").isin(new)) for table in rows]
    sums = sum_by(reduce(DataFrame.unionByName, rows), [*FILE, *KEYS], MEASURES)
    batch = uuid.uuid4().hex
    sums.write.parquet(f"{store}/.batch-{batch}")
    fs = _path(spark, store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(_path(spark, f"{store}/.batch-{batch}"), _path(spark, f"{store}/batch-{batch}")):
        raise RuntimeError(f"could not take the batch {batch} into {store}")
    return new


def _file_columns() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ]


def _named(results: DataFrame) -> DataFrame:
    """The rows with their file; columns that only some reports use may be absent."""
    types = {f.name: f.dataType for f in RESULTS}
    absent = {
        n: F.lit(None).cast(types[n]) for n in (*KEYS, *MEASURES) if n not in results.columns
    }
    rows = results.withColumns(absent) if absent else results
    return rows.select(*_file_columns(), *KEYS, *MEASURES)


def stored_sums(spark: SparkSession, store: str) -> DataFrame | None:
    """All sums of a store, also of files that have changed since; none if there is no store."""
    path = _path(spark, store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(
        entry.getPath().getName().startswith("batch-") for entry in fs.listStatus(path)
    ):
        return None
    return spark.read.schema(STORED).parquet(f"{store}/batch-*")


def read_summaries(spark: SparkSession, store: str) -> DataFrame:
    """The sums in force, with the columns of results: of a file that changed, those of its last state."""
    store = store.rstrip("/")
    sums = stored_sums(spark, store)
    if sums is None:
        raise FileNotFoundError(f"no sums in {store}")
    last = sums.groupBy("file").agg(F.max("modified").alias("modified"))
    current = sums.join(last, list(FILE), "left_semi").drop(*FILE)
    absent = [f for f in RESULTS if f.name not in current.columns]
    return current.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)
