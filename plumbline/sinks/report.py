"""Saved reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import order_rows
from plumbline.plans.profiles import Profile
from plumbline.plans.report import SUBTITLES, both_sections, section_table


MANIFEST, VERSION = "manifest-", "version-"


def save_table(table: DataFrame, path: str, table_format: str) -> None:
    """Write a table, replacing what is there; text files get a header line."""
    writer = table.write.format(table_format).mode("overwrite")
    (writer.option("header", True) if table_format == "csv" else writer).save(path)


def save_report(
    comparison: DataFrame, profile: Profile, folder: str, table_format: str = "csv"
) -> dict[str, str]:
    """Write a comparison and its two section tables below ``folder``; return their paths.

    The comparison is computed once, into ``folder/data`` with numbers and plain names, and the
    labelled section tables are made from that small stored copy, so the results are read once. Tables
    are replaced one by one; ``publish_report`` replaces all at once.
    """
    folder = folder.rstrip("/")
    paths = {name: f"{folder}/{name}" for name in ("data", *SUBTITLES)}
    sections = both_sections(comparison)
    sections.write.mode("overwrite").partitionBy("section").parquet(paths["data"])
    stored = comparison.sparkSession.read.schema(sections.schema).parquet(paths["data"])
    for name in SUBTITLES:
        rows = order_rows(stored.where(F.col("section") == name).drop("section"), *profile.ids)
        save_table(section_table(rows, profile, name), paths[name], table_format)
    return paths


def publish_report(
    comparison: DataFrame, profile: Profile, folder: str, table_format: str = "csv", keep: int = 2
) -> dict[str, str]:
    """``save_report`` as a new version below ``folder``, which takes effect at once and whole.

    The tables go to a folder of their own. When all are written, a manifest of the next number names
    that folder; readers take the highest number. What stops before leaves the old version in force. Of
    earlier versions, the ``keep`` newest in all stay for readers that began with them.
    """
    spark, folder = comparison.sparkSession, folder.rstrip("/")
    version = f"{VERSION}{uuid.uuid4().hex}"
    save_report(comparison, profile, f"{folder}/{version}", table_format)
    fs, root = _folder(spark, folder)
    known = _manifests(fs, root)
    number = max(known, default=0) + 1
    # Written aside and renamed: a manifest is there whole or not at all, and no two have one number.
    aside = _path(spark, f"{folder}/.{MANIFEST}{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(version.encode()))
    out.close()
    if not fs.rename(aside, _path(spark, f"{folder}/{MANIFEST}{number}")):
        fs.delete(aside, False)
        raise RuntimeError(f"another report was published in {folder}; its version stays in force")
    for old in sorted(known)[: max(0, len(known) + 1 - keep)]:
        old_version = _version(fs, known[old])
        fs.delete(known[old], False)
        fs.delete(_path(spark, f"{folder}/{old_version}"), True)
    return _report_paths(folder, version)


def published_report(spark: SparkSession, folder: str) -> dict[str, str]:
    """The paths of the version of a published report that is in force."""
    folder = folder.rstrip("/")
    fs, root = _folder(spark, folder)
    known = _manifests(fs, root)
    if not known:
        raise FileNotFoundError(f"no report was published in {folder}")
    return _report_paths(folder, _version(fs, known[max(known)]))


def _report_paths(folder: str, version: str) -> dict[str, str]:
    return {name: f"{folder}/{version}/{name}" for name in ("data", *SUBTITLES)}


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, folder: str):
    root = _path(spark, folder)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _manifests(fs, root) -> dict[int, object]:
    """The manifests of a folder by their numbers; a handful, as old ones are removed."""
    if not fs.exists(root):
        return {}
    paths = [entry.getPath() for entry in fs.listStatus(root)]
    found = {path.getName(): path for path in paths}
    return {int(n.removeprefix(MANIFEST)): p for n, p in found.items() if n.startswith(MANIFEST)}


def _version(fs, manifest) -> str:
    stream = fs.open(manifest)
    data = bytes(stream.readAllBytes())
    stream.close()
    return data.decode()
