"""Finding input files."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCHEME_AND_HOST = r"^(?:[^:/]+:)?(?://[^/]*)?"


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the newest file in a folder whose name contains a regex match.

    A directory counts as one file, as new as the newest file in it. Only names and times are read,
    never contents. Empty files do not count; of files equally new, the last by name wins.

    One level is listed by the driver. Only folders whose names match are looked into, all of them at once:
    Spark lists their subfolders in tasks, and tasks find the newest time of each.
    """
    inside = re.sub(SCHEME_AND_HOST, "", folder).rstrip("/")
    if not inside.startswith("/"):
        raise ValueError(f"not an absolute folder: {folder}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: tuple[int, str] | None = None
    folders = []
    entries = fs.listStatusIterator(root)
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if not re.search(pattern, name) or name.startswith(("_", ".")):
            continue
        if entry.isDirectory():
            folders.append(entry.getPath().toString())
        elif entry.getLen():
            found = (entry.getModificationTime(), entry.getPath().toString())
            newest = found if newest is None else max(newest, found)
    if folders:
        found = _newest_folder(spark, folders)
        newest = max((x for x in (newest, found) if x is not None), default=None)
    if newest is None:
        raise FileNotFoundError(f"no file matching {pattern!r} in {folder}")
    return newest[1]


def _newest_folder(spark: SparkSession, folders: list[str]) -> tuple[int, str] | None:
    """When the newest file with contents in any of the folders was written, and in which."""
    globs = [re.sub(r"([\[\]{}*?\\])", r"\\\1", path) for path in folders]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(globs)
    parent = folders[0].rpartition("/")[0]
    name = F.substring_index(F.expr(f"substring(path, {len(parent) + 2})"), "/", 1)
    # The contents are not selected, so no file is opened.
    files = listed.where(F.col("length") > 0).select(
        F.unix_millis("modificationTime").alias("time"), F.concat(F.lit(f"{parent}/"), name).alias("folder")
    )
    found = files.agg(F.max(F.struct("time", "folder")).alias("newest")).first().newest
    return None if found is None else (found.time, found.folder)
