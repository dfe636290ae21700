"""Helpers shared by the operators: stored tables, running sums, salted joins, bound expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of characters other than these.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARACTERS = " \t\n\x0b\f\r"
SALTS = 32

_own_dir: list[str] = []
_shipped: set[str] = set()
PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once to an application, as ``--py-files`` would."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="plumbline-package-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own for as long as the driver lives;
    a cluster gets an error, because a local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _own_dir[0], True)
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder: lost executors cost nothing, sizes are known."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has; null counts as empty."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


def without_spaces(text: Column) -> Column:
    return F.translate(text, SPACE_CHARACTERS, "")


def running(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str) -> DataFrame:
    """Adds the row's rank from 0 and, for each ``{new: column}``, the sum over earlier rows.

    Rows are dealt by range, numbered inside their range and shifted by the ranges before it, so no
    task sees all rows. Only one row per range meets in the last window.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_t_{n}") for n, c in sums.items())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.select(
        "*",
        (F.row_number().over(inside) - 1).alias("_row"),
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_i_{n}") for n, c in sums.items()),
    )
    return numbered.join(shifts, "_range").select(
        *df.columns,
        (F.col("_row") + F.col("_before")).alias(rank),
        *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums),
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "left",
    parts: str | None = None,
) -> DataFrame:
    """Joins ``right``, unique in ``keys``, without gathering the left rows of a key.

    Left rows of a key are spread over ``SALTS`` parts and the right rows repeated for each, or for those of the
    column ``parts``, made by ``parts_of`` from the left rows; missing keys match each other. The rows
    are repeated by an unpivot, as Spark sizes that by what comes out and an explode by what goes in: it
    would broadcast a table of up to ``SALTS`` times the threshold.
    """
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    right = right.select(*named, *(c for c in right.columns if c not in keys))
    numbers = {f"_salt_{i}": F.lit(i) for i in range(SALTS)}
    salted = right.withColumns(numbers).unpivot(right.columns, [*numbers], "_salt_name", "_salt_r")
    salted = salted.drop("_salt_name")
    if parts:
        salted = salted.where(F.getbit(parts, F.col("_salt_r")) == 1).drop(parts)
    dealt = left.withColumn("_salt", _part(spread))
    on = F.col("_salt") == F.col("_salt_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = dealt.join(salted, on, how)
    return joined.drop("_salt", "_salt_r", *(f"_k_{k}" for k in keys))


def parts_of(spread: Column) -> Column:
    """An aggregate of left rows: the parts of a salted join that they are in, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _part(spread)))


def _part(spread: Column) -> Column:
    return F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
