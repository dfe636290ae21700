"""Resampling of documents towards the distribution of a target table, by importance weights.

Separators of a text collapse to single spaces, and one overlapped scan of a regular expression emits
the spans of its n-grams: a match begins at every word, and its groups end the runs of 1, 2, ... words.
The CRC of a span's bytes names its bucket. The ratio of the smoothed shares of a bucket in target and
corpus is its gain, the mean gain of a document its weight, and weights with Gumbel noise drawn from
doc_id rank the documents: the highest are a sample without replacement.

Buckets of a text are stored, two bytes a feature, so that texts are scanned once. Only the counts of
the buckets, a number set by ``buckets``, reach the driver.

Defined cases: a text that is null or without words has no features, weight 0, and is not drawn; a
missing doc_id counts as the text "null" and comes first among ties; repeated rows are separate
documents; with an empty corpus nothing is returned, and with an empty target every bucket has the
target share 1 / ``buckets``; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import running, ship, stored

# Bytes that are no letter or digit of ASCII become spaces, and A-Z small; bytes above 127 stay.
_PLAIN = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)
NONE = np.array([], dtype=np.int64)


@dataclass(frozen=True)
class ResampleSettings:
    """Features are runs of 1 to ``most_words`` words, hashed into ``buckets`` (65,536 at most). Of
    the documents with ``least_words``, ``percent`` in a hundred are drawn; ``seed`` sets the noise.
    """

    most_words: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: str = "7"

    def __post_init__(self) -> None:
        if not (1 <= self.buckets <= 1 << 16 and self.most_words >= 1 and 0 <= self.percent <= 100):
            raise ValueError(f"settings out of range: {self}")


def collapsed(text: str) -> bytes:
    """The words of a text in small letters, with single spaces between."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def span_pattern(most_words: int) -> regex.Pattern:
    """Matches at each word; group n ends the run of n words, where there is one."""
    return regex.compile(rb"(?<![^ ])([^ ]++)" + rb"( [^ ]++)?" * (most_words - 1) + rb"(?![^ ])")


def ngram_spans(data: bytes, pattern: regex.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of every run of words in a collapsed text, by start and length."""
    groups = range(1, pattern.groups + 1)
    for match in pattern.finditer(data, overlapped=True):
        for n in groups:
            end = match.end(n)
            if end < 0:
                break
            yield match.start(), end


def text_buckets(text: str | None, pattern: regex.Pattern, buckets: int) -> np.ndarray:
    """The bucket of each feature of a text, repeats included."""
    data = collapsed(text or "")
    hashes = [zlib.crc32(data[a:b]) for a, b in ngram_spans(data, pattern)]
    return np.array(hashes, dtype=np.int64) % buckets if hashes else NONE


def featured(rows: DataFrame, settings: ResampleSettings, *carried: str) -> DataFrame:
    """The ``carried`` columns, text_hash, n_words, n_features and ``buckets``, bytes of 16-bit numbers."""
    ship(rows.sparkSession)

    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pattern = span_pattern(settings.most_words)
        for batch in texts:
            found = [text_buckets(t, pattern, settings.buckets) for t in batch]
            sizes = [len(f) for f in found]
            words = [_words_of(n, settings.most_words) for n in sizes]
            packed = [f.astype("<u2").tobytes() for f in found]
            yield pd.DataFrame({"n_words": words, "n_features": sizes, "buckets": packed})

    scanned = F.pandas_udf(scan, "n_words long, n_features long, buckets binary")
    kept = rows.select(*carried, F.xxhash64("text").alias("text_hash"), scanned("text").alias("_f"))
    return kept.select(*carried, "text_hash", "_f.*")


def _words_of(n_features: int, most_words: int) -> int:
    """How many words have so many runs of 1 to ``most_words`` words."""
    n = 0
    while n < most_words and n * (n + 1) // 2 < n_features:
        n += 1
    return n + (n_features - n * (n + 1) // 2) // most_words


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has; a task sends one row for each bucket it has."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for frame in frames:
            for data in frame["buckets"]:
                total += np.bincount(np.frombuffer(data, dtype="<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    counted = features.select("buckets").mapInPandas(count, "bucket BIGINT, n BIGINT")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of smoothed shares, rounded down."""
    n = len(corpus)
    up, down = int(corpus.sum()) + n, int(target.sum()) + n
    ratios = ((float(t + 1) * up) / (float(s + 1) * down) for t, s in zip(target, corpus, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def scored(
    docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()
) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score: a stored row for each row of ``docs``
    (doc_id, text), weighed against ``target`` (text).
    """
    features = stored(featured(docs, settings, "doc_id"), "features")
    wanted = bucket_counts(featured(target, settings), settings.buckets)
    gains = bucket_gains(wanted, bucket_counts(features, settings.buckets))

    @F.pandas_udf("long")
    def total_gain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([int(gains[np.frombuffer(b, dtype="<u2")].sum()) for b in batch])

    n = F.col("n_features")
    weight = F.when(n == 0, 0).otherwise(F.floor((F.col("_total") - F.pmod("_total", n)) / n))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), name), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = features.withColumn("_total", total_gain("buckets")).withColumn(
        "weight", weight.cast("long")
    )
    columns = ("doc_id", "text_hash", "n_words", "n_features", "weight")
    return stored(weighed.select(*columns, (F.col("weight") + noise).alias("score")), "scores")


def ranked(scores: DataFrame, settings: ResampleSettings = ResampleSettings()) -> DataFrame:
    """The rows of ``scored`` with ``rank``: 1, 2, ... for those drawn, null for the others."""
    enough = F.col("n_words") >= settings.least_words
    drawn = settings.percent * scores.where(enough).count() // 100
    # Equal rows are told apart by their place, so that no key is too frequent to be dealt out.
    placed = scores.withColumn("_place", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("text_hash"), F.asc("_place")]
    numbered = running(placed.where(enough), order, {}, "_rank").withColumn(
        "rank", F.when(F.col("_rank") < drawn, F.col("_rank") + 1)
    )
    others = scores.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return numbered.select(*others.columns).unionByName(others)


def resampled(
    docs: DataFrame, target: DataFrame, settings: ResampleSettings = ResampleSettings()
) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns.

    Equal rows have equal scores and stand together, so at most one group of them is drawn in part.
    """
    key = ["doc_id", "text_hash"]
    ranks = stored(ranked(scored(docs, target, settings), settings), "ranks")
    groups = ranks.where(F.col("n_words") >= settings.least_words).groupBy(*key)
    groups = groups.agg(F.count("*").alias("_n"), F.count("rank").alias("_drawn")).where("_drawn > 0")
    groups = stored(groups, "drawn")
    part = groups.where("_drawn < _n").first()

    def rows_of(chosen: DataFrame) -> DataFrame:
        on = F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_hash"))
        return docs.join(chosen, on.eqNullSafe(F.struct(*(chosen[k] for k in key))), "left_semi")

    whole = rows_of(groups.where("_drawn = _n"))
    if part is None:
        return whole
    return whole.unionByName(rows_of(groups.where("_drawn < _n")).limit(part["_drawn"]))
