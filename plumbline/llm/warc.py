"""WARC archives: a writer of one gzip member per record, and a reader that splits files anywhere.

A reading task gets a byte range of a file. It looks for gzip magic in the range, decompresses the
start of each candidate and accepts it when a WARC header follows; chance matches inside compressed
data fail that. A record belongs to the range in which it starts, and is read past the end of the range if need be.
After a record the search goes on behind it.

Files are reached through Arrow's file systems (local paths, HDFS, S3 and the like), record by record.
The writer's tasks report their files, and only reported files are read, so that a task that ran
twice leaves no records twice.

Defined cases: a null payload is empty; a null url or page_id leaves its field empty; control characters in
a URL are percent-encoded; rows with equal payloads and the same smallest page_id are all responses;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import new_path, salted_join, ship, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
# How much of a candidate is read to decide whether it is a record.
PROBE = 4096
CHUNK = 1 << 20
RECORDS = (
    "page_id BIGINT, url STRING, record_type STRING, refers_to BIGINT, payload_digest STRING, "
    "payload_bytes BIGINT, payload BINARY"
)


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Spark path and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    path = re.sub(r"^s3[an]://", "s3://", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(header: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*header, ("Content-Length", str(len(block)))]
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _escape(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def encode_record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool
) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, with the payload's length, without the payload."""
    named = lambda i: f"<urn:page:{'' if i is None else i}>"
    header = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", named(page_id)),
        ("WARC-Target-URI", "" if url is None else _escape(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        header += [
            ("WARC-Refers-To", named(refers_to)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _member(header, http.encode() + (b"" if revisit else payload))


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n") if b":" in line)
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in pairs}


def decode_record(data: bytes) -> dict:
    """The record in a decompressed member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head[len(VERSION) :])
    block = rest[: int(warc["content-length"])]
    http_head, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    revisit = warc["warc-type"] == "revisit"
    return {
        "page_id": number(warc["warc-record-id"]),
        "url": warc["warc-target-uri"],
        "record_type": warc["warc-type"],
        "refers_to": number(warc["warc-refers-to"]) if revisit else None,
        "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:")
        if revisit
        else base32_sha1(payload),
        "payload_bytes": int(_fields(http_head)["content-length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


def _is_record(start: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(start, PROBE).startswith(b"WARC/")
    except zlib.error:
        return False


def _read_member(file, at: int) -> tuple[bytes, int] | None:
    """The decompressed member at ``at`` and the place behind it; None if it is no whole member."""
    unpack, parts = zlib.decompressobj(31), []
    file.seek(at)
    while not unpack.eof:
        data = file.read(CHUNK)
        if not data:
            return None
        at += len(data)
        try:
            parts.append(unpack.decompress(data))
        except zlib.error:
            return None
    return b"".join(parts), at - len(unpack.unused_data)


def records_in_range(file, start: int, end: int) -> Iterator[dict]:
    """The records of an archive that start in [start, end)."""
    at = start
    while at < end:
        file.seek(at)
        # Magic may begin on the last byte of the range.
        window = file.read(min(CHUNK, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += min(CHUNK, end - at)
            continue
        at += found
        file.seek(at)
        member = _read_member(file, at) if _is_record(file.read(PROBE)) else None
        if member is None:
            at += 1
        else:
            yield decode_record(member[0])
            at = member[1]


def with_first_of_equal(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (bytes), ``first``: the smallest page_id with an equal payload."""
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    digest = F.sha2("payload", 256)
    # Only payloads that occur twice can have revisits; the pages need not meet by payload.
    firsts = (
        rows.groupBy(digest.alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    firsts = stored(firsts, "firsts")
    keyed = rows.withColumn("digest", digest)
    joined = salted_join(keyed, firsts, ["digest"], F.struct("page_id", "url"))
    first = F.coalesce("first", "page_id")
    return joined.select("page_id", "url", "payload", first.alias("first"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the pages below ``folder``, a file for each task; returns (path, bytes) of the files."""

    ship(pages.sparkSession)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _open_fs(folder)
        fs.create_dir(base, recursive=True)
        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
        stream, size = None, 0
        for frame in frames:
            if stream is None and len(frame):
                stream = fs.open_output_stream(path, compression=None)
            rows = zip(
                frame["page_id"].astype(object),
                frame["url"],
                frame["payload"],
                frame["first"].astype(object),
                strict=True,
            )
            for page_id, url, payload, first in rows:
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                revisit = page_id != first
                data = encode_record(page_id, url, bytes(payload), first, revisit)
                stream.write(data)
                size += len(data)
        if stream is not None:
            stream.close()
            yield pd.DataFrame({"path": [path], "bytes": [size]})

    # Numbers with missing values would come as doubles and lose digits.
    exact = pages.select(
        F.col("page_id").cast("string").alias("page_id"),
        "url",
        "payload",
        F.col("first").cast("string").alias("first"),
    )
    return stored(exact.mapInPandas(write, "path STRING, bytes BIGINT"), "archives")


def read_archives(
    archives: DataFrame, folder: str, range_bytes: int = 8 << 20, task_ranges: int = 8
) -> DataFrame:
    """The records of the files in ``archives``, read in ranges of ``range_bytes``.

    A range is a small row and much work, so the number of tasks is told: one for ``task_ranges``
    ranges, dealt out in turn, and at least as many as there are cores.
    """
    ship(archives.sparkSession)
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    held = archives.where("bytes > 0")
    ranges = held.select("path", F.explode(starts).alias("start"), F.col("bytes"))
    n = held.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    cores = archives.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(cores, -(-n // task_ranges))))
    ranges = ranges.select(
        "path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end")
    ).repartition(tasks)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open_fs(folder)
        for frame in frames:
            for path, start, end in zip(frame["path"], frame["start"], frame["end"], strict=True):
                rows, held = [], 0
                with fs.open_input_file(path) as file:
                    for record in records_in_range(file, int(start), int(end)):
                        rows.append(record)
                        held += len(record["payload"] or b"")
                        if held > 4 * CHUNK or len(rows) >= 2000:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    return ranges.mapInPandas(read, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    for name in ("page_id", "refers_to", "payload_bytes"):
        frame[name] = pd.array(frame[name].tolist(), dtype="Int64")
    return frame


def archive_and_read(pages: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    archives = write_archives(with_first_of_equal(pages), folder)
    return read_archives(archives, folder, range_bytes)
