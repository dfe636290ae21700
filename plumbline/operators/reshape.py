"""Long to wide and wide to long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.storage import stored
from plumbline.operators.sums import sum_by

# Columns that a pivot makes of names nobody listed.
MOST_NAMES = 100


def pivot_wider(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    names: Sequence[str] | None,
    measures: Sequence[str],
    duplicates: str = "error",
    unlisted: str = "error",
    most_names: int = MOST_NAMES,
) -> DataFrame:
    """One row per id, one column per name (``name``, or ``measure_name`` for several measures).

    A name without a row is NULL. Two rows for one id and name stop the query; with
    ``duplicates="sum"`` they are added, ignoring missing values: by id and name first, so that raw
    rows meet one sum per measure and only those sums the many columns.

    With ``names`` given, no job is run. A row whose name is missing or not listed stops the query,
    naming its id; with ``unlisted="drop"`` only the listed names are kept, and an id without any gives
    no row. With ``names=None`` the columns are the names that occur, in order: the rows, summed if they
    are to be, are stored once, and their names read from there. More than ``most_names``, or a
    missing one, are refused.
    """
    if unlisted not in ("error", "drop"):
        raise ValueError(f"unknown rule for unlisted names: {unlisted}")
    if duplicates not in ("error", "sum"):
        raise ValueError(f"unknown duplicates rule: {duplicates}")

    is_listed = F.lit(True) if names is None else F.coalesce(F.col(names_from).isin(*names), F.lit(False))
    if unlisted == "drop":
        df = df.where(is_listed)
    if duplicates == "sum":
        df = sum_by(df, [*ids, names_from], measures)
    if names is None:
        df = stored(df.select(*ids, names_from, *measures), "pivot")
        names = names_in(df, names_from, most_names)

    def column(measure: str, name: str) -> str:
        return str(name) if len(measures) == 1 else f"{measure}_{name}"

    # Buffers of numbers alone, so that the wide aggregate need not sort: a row that is not listed stops the
    # query where it is met, and of the names with two rows only their numbers are kept.
    id_text = F.concat_ws(", ", *[F.col(key).cast("string") for key in ids])
    name_text = F.coalesce(F.col(names_from).cast("string"), F.lit("NULL"))
    told = F.concat(F.lit(f"{names_from} "), name_text, F.lit(" is not listed, for "), id_text)
    checks = {}
    if unlisted == "error":
        checks["unlisted rows"] = F.sum(F.when(is_listed, 0).otherwise(F.raise_error(told).cast("int")))
    if duplicates == "error":
        checks |= {f"rows of {n}": F.count_if(F.col(names_from) == n) for n in names}
    cells = {
        column(m, n): F.max(F.when(F.col(names_from) == n, F.col(m))) for m in measures for n in names
    }
    wide = df.groupBy(*ids).agg(
        *[check.alias(name) for name, check in checks.items()],
        *[cell.alias(name) for name, cell in cells.items()],
    )
    # One check for each row of the wide table; every cell needs it, so that it stays whatever is read.
    fine = F.lit(True)
    if unlisted == "error":
        fine = F.col("unlisted rows") == 0
    if duplicates == "error" and names:
        twice = F.coalesce(*[F.when(F.col(f"`rows of {n}`") > 1, F.lit(str(n))) for n in names])
        told = F.concat(F.lit(f"more than one {measures[0]} in "), twice, F.lit(" for "), id_text)
        fine = F.when(twice.isNull(), fine).otherwise(F.raise_error(told).cast("boolean"))
    checked = wide.withColumn("checked row", fine)
    return checked.select(*ids, *[F.when(F.col("checked row"), F.col(f"`{c}`")).alias(c) for c in cells])


def names_in(df: DataFrame, names_from: str, most_names: int = MOST_NAMES) -> list:
    """The distinct names of a column, in order, of which there may be ``most_names``."""
    found = [row[0] for row in df.select(names_from).distinct().limit(most_names + 1).collect()]
    if len(found) > most_names:
        raise ValueError(f"more than {most_names} names in {names_from}")
    if None in found:
        raise ValueError(f"{names_from} is missing in some rows")
    return sorted(found)


def unpivot_years(
    wide: DataFrame,
    year_columns: Mapping[str, int],
    value: str = "targets",
    drop_missing: bool = False,
) -> DataFrame:
    """Turn a table with one column per year into rows of ``fiscal_year`` and the value."""
    ids = [name for name in wide.columns if name not in year_columns]
    renamed = wide.withColumnsRenamed({old: str(year) for old, year in year_columns.items()})
    years = [str(year) for year in year_columns.values()]
    long = renamed.unpivot(ids, years, "fiscal_year", value).withColumn(
        "fiscal_year", F.col("fiscal_year").cast("int")
    )
    return long.where(F.col(value).isNotNull()) if drop_missing else long
