"""Readers of the input tables.

Columns are taken by name. Those every comparison uses must exist, those only some use may be
absent; both get their declared type. Others pass through untouched and cost nothing until selected.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.columns import require_columns


def _schema(text: str = "", integer: str = "", double: str = "") -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in text.split()]
    fields += [T.StructField(name, T.IntegerType()) for name in integer.split()]
    fields += [T.StructField(name, T.DoubleType()) for name in double.split()]
    return T.StructType(fields)


RESULTS = _schema(
    text="operatingunit country indicator numeratordenom standardizeddisaggregate "
    "funding_agency mech_code source_name",
    integer="fiscal_year",
    double="targets cumulative",
)
PLAN = _schema(
    text="operatingunit country psnu psnuuid indicator numeratordenom standardizeddisaggregate",
    integer="fiscal_year",
    double="targets cumulative",
)
MAPPING = _schema(text="indicator numeratordenom standardizeddisaggregate")
HIERARCHY = _schema(text="operatingunit countryname psnu psnuuid")

# Used only by some profiles or checks, which then say if they miss one.
OPTIONAL = ("country", "cumulative", "psnu", "psnuuid", "source_name")

SEPARATORS = {"csv": ",", "tsv": "\t"}
ARCHIVES = (".zip", ".rds", ".xlsx", ".xls")


def _read(
    spark: SparkSession,
    path: str,
    file_format: str,
    schema: T.StructType,
    optional: Sequence[str] = (),
    quote: str = '"',
) -> DataFrame:
    """A text line with too few or too many fields, or a quote that does not close on its line, stops the
    query, also where few columns are read. An empty ``quote`` takes quotes as they stand.
    """
    _refuse_archive(path)
    if file_format in SEPARATORS:
        text = _text_reader(spark, file_format, quote).option("mode", "FAILFAST").csv(path)
        df = _without_na(text, text.columns)
    elif file_format in ("parquet", "orc"):
        df = spark.read.format(file_format).load(path)
    else:
        raise ValueError(f"unknown format: {file_format}")
    return conform(df, schema, optional)


def _refuse_archive(path: str) -> None:
    if path.lower().endswith(ARCHIVES):
        raise ValueError(f"convert {path} to text or Parquet first: Spark would read it as garbage")


def _text_reader(spark: SparkSession, file_format: str, quote: str) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("sep", SEPARATORS[file_format])
        # Otherwise a file whose columns are in another order would be misread.
        .option("enforceSchema", False)
        .option("quote", quote)
        # With pruning, a short line passes as long as the columns that are read are there.
        .option("columnPruning", False)
    )


def _without_na(text: DataFrame, names: Sequence[str]) -> DataFrame:
    return text.select(*[F.nullif(F.col(f"`{n}`"), F.lit("NA")).alias(n) for n in names])


class Quarantined(NamedTuple):
    """Lines that can be read, as a table, and the others with ``file``, ``line`` and ``reason``."""

    good: DataFrame
    bad: DataFrame


def read_with_quarantine(
    spark: SparkSession,
    path: str,
    file_format: str,
    schema: T.StructType,
    optional: Sequence[str] = (),
    quote: str = '"',
) -> Quarantined:
    """Text lines as a reader of ``schema`` would give them, without stopping at damaged ones.

    Every line below a header is in one of both tables. The reasons are "open quote", "too few fields" and
    "too many fields". Files whose header differs from that of the first still stop the query: their
    lines may be whole, but mean something else.
    """
    _refuse_archive(path)
    if file_format not in SEPARATORS:
        raise ValueError(f"only text has damaged lines, not {file_format}")
    sep = SEPARATORS[file_format]
    names = _text_reader(spark, file_format, quote).csv(path).columns
    whole, damaged = sep.join(names), "damaged line"
    # Each line as one field, below a header that is checked as one name.
    lines = (
        _text_reader(spark, file_format, "")
        .option("sep", "\x01")
        .schema(T.StructType([T.StructField(whole, T.StringType())]))
        .csv(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col(f"`{whole}`").alias("line"))
    )
    fields = T.StructType([T.StructField(name, T.StringType()) for name in (*names, damaged)])
    options = {"sep": sep, "quote": quote, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": damaged}
    parsed = F.from_csv("line", ", ".join(f"`{f.name}` STRING" for f in fields), options)
    # What is left when quoted fields that end where a field ends are taken away.
    closed = rf"(?<=^|{sep}){quote}(?:[^{quote}\\]|\\.|{quote}{quote})*{quote}(?={sep}|$)"
    rest = F.regexp_replace("line", closed, "") if quote else F.col("line")
    is_open = rest.rlike(rf"(?:^|{sep}){quote}") if quote else F.lit(False)
    few = F.size(F.split(rest, sep, -1)) < len(names)
    reason = F.when(is_open, "open quote").when(few, "too few fields").otherwise("too many fields")
    told = lines.select("file", "line", reason.alias("reason"), is_open.alias("open"), parsed.alias("row"))
    is_bad = F.col("open") | F.col("row").getField(damaged).isNotNull()
    bad = told.where(is_bad).select("file", "line", "reason")
    good = told.where(~is_bad).select(*[F.col("row").getField(n).alias(n) for n in names])
    return Quarantined(conform(_without_na(good, names), schema, optional), bad)


def conform(df: DataFrame, schema: T.StructType, optional: Sequence[str] = ()) -> DataFrame:
    """Check that the schema's columns exist, unless optional, and cast those of another type.

    A column already of its type is left alone, so filters on it still reach the scan.
    """
    require_columns(df, [name for name in schema.fieldNames() if name not in optional])
    present = {field.name: field.dataType for field in df.schema}
    casts = {
        field.name: F.col(field.name).cast(field.dataType)
        for field in schema
        if present.get(field.name, field.dataType) != field.dataType
    }
    return df.withColumns(casts) if casts else df


def read_results(
    spark: SparkSession, path: str, file_format: str = "parquet", quote: str = '"'
) -> DataFrame:
    """Long results table. Parquet partitioned by ``fiscal_year`` lets year floors prune."""
    return _read(spark, path, file_format, RESULTS, OPTIONAL, quote)


def read_plan(
    spark: SparkSession, path: str, file_format: str = "parquet", quote: str = '"'
) -> DataFrame:
    """Long plan table."""
    return _read(spark, path, file_format, PLAN, OPTIONAL, quote)


def read_mapping(
    spark: SparkSession, path: str, file_format: str = "parquet", quote: str = '"'
) -> DataFrame:
    """Valid indicator, numeratordenom and disaggregate triples."""
    return _read(spark, path, file_format, MAPPING, quote=quote)


def read_hierarchy(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    ou_uid: str | None = None,
    quote: str = '"',
) -> DataFrame:
    """Sites with their country; ``ou_uid`` selects one operating unit by ``operatingunituid``."""
    hierarchy = _read(spark, path, file_format, HIERARCHY, quote=quote)
    if ou_uid is None:
        return hierarchy
    require_columns(hierarchy, ["operatingunituid"])
    return hierarchy.where(F.col("operatingunituid") == ou_uid)
