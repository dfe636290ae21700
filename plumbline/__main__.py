"""Run a report or a check: ``python -m plumbline <name> --results ... --output ...``.

What is written goes below ``<output>/<name>``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import quality
from plumbline.plans.compare import compare
from plumbline.plans.indicators import indicator_total
from plumbline.plans.profiles import PROFILES
from plumbline.sinks import save_report
from plumbline.sinks.report import save_table
from plumbline.sources import latest_file, read_hierarchy, read_mapping, read_plan, read_results

READERS = {
    "results": read_results,
    "plan": read_plan,
    "mapping": read_mapping,
    "hierarchy": read_hierarchy,
}


class Check(NamedTuple):
    """The tables and options that a check needs, and its rows from both."""

    tables: tuple[str, ...]
    rows: Callable[[dict[str, DataFrame], dict], DataFrame]
    options: tuple[str, ...] = ()


CHECKS = {
    "completeness": Check(("results",), lambda t, o: quality.disagg_completeness(t["results"])),
    "list_disaggregates": Check(
        ("results",), lambda t, o: quality.list_disaggregates(t["results"])
    ),
    "indicator_total": Check(
        ("results",),
        lambda t, o: indicator_total(
            t["results"], o["indicator"], o["disaggregate"], o["year"], o["measure"]
        ),
        ("indicator", "disaggregate", "year"),
    ),
    "hierarchy_conflicts": Check(
        ("hierarchy",), lambda t, o: quality.hierarchy_conflicts(t["hierarchy"])
    ),
    "shared_years": Check(
        ("results", "plan"), lambda t, o: quality.shared_years(t["results"], t["plan"])
    ),
    "absent_years": Check(
        ("results", "plan"),
        lambda t, o: quality.absent_years(t["results"], t["plan"], PROFILES[o["profile"]]),
        ("profile",),
    ),
    "unlisted_years": Check(
        ("results", "plan"),
        lambda t, o: quality.unlisted_years(t["results"], t["plan"], PROFILES[o["profile"]]),
        ("profile",),
    ),
    "unmatched_sites": Check(
        ("plan", "hierarchy"),
        lambda t, o: quality.unmatched_sites(
            t["plan"],
            t["hierarchy"],
            PROFILES[o["profile"]].plan_year,
            PROFILES[o["profile"]].operatingunit,
        ),
        ("profile",),
    ),
}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    parser.add_argument("name", choices=[*PROFILES, *CHECKS])
    for table in READERS:
        parser.add_argument(f"--{table}", help=f"path of the {table} table")
        parser.add_argument(
            f"--{table}-pattern", help=f"take the newest match of this regex inside --{table}"
        )
        parser.add_argument(f"--{table}-format", help="if not --input-format")
    parser.add_argument("--input-format", default="parquet", help="parquet, orc, csv or tsv")
    parser.add_argument("--quote", default='"', help="quote character of text files; empty: none")
    parser.add_argument("--ou-uid", help="take one operating unit of the hierarchy")
    parser.add_argument("--profile", choices=PROFILES, help="report whose years or sites to check")
    for name in ("indicator", "disaggregate", "year"):
        parser.add_argument(f"--{name}", help="for indicator_total")
    parser.add_argument("--measure", default="cumulative", help="for indicator_total")
    parser.add_argument("--output", required=True)
    parser.add_argument("--format", default="csv", help="format of the written tables")
    return parser


def run(spark: SparkSession, arguments: Sequence[str]) -> None:
    """Read the tables the report or check needs, compute it and save it."""
    parser = _parser()
    options = vars(parser.parse_args(arguments))
    name = options["name"]
    if name in CHECKS:
        needed, wanted = CHECKS[name].tables, CHECKS[name].options
    else:
        places = ("hierarchy",) if PROFILES[name].by_country else ()
        needed, wanted = ("results", "plan", "mapping", *places), ()
    missing = [f"--{option}" for option in (*needed, *wanted) if options[option] is None]
    if missing:
        parser.error(f"{name} needs {', '.join(missing)}")

    tables = {}
    for table in needed:
        path, pattern = options[table], options[f"{table}_pattern"]
        path = path if pattern is None else latest_file(spark, path, pattern)
        more = {"ou_uid": options["ou_uid"]} if table == "hierarchy" else {}
        file_format = options[f"{table}_format"] or options["input_format"]
        tables[table] = READERS[table](spark, path, file_format, quote=options["quote"], **more)

    folder = f"{options['output'].rstrip('/')}/{name}"
    if name in CHECKS:
        save_table(CHECKS[name].rows(tables, options), folder, options["format"])
    else:
        comparison = compare(profile=PROFILES[name], **tables)
        save_report(comparison, PROFILES[name], folder, options["format"])


if __name__ == "__main__":
    run(SparkSession.builder.appName("plumbline").getOrCreate(), sys.argv[1:])
