"""Quality rules from counts within a document and from lines that many documents of a host share.

Lines are normalised and hashed; the documents that have a line are counted per host (the source),
texts that are equal counting once: what is copied whole is for the removal of duplicates, which keeps
one copy, where this rule would keep none. A line above the limit is boilerplate, whatever the size of the
host: its words do not count as the document's own. A document of which too little is left is
depleted and rejected. DataFrame functions only.

Defined cases: a text that is null or without words has no words and fails; a missing source is a host
of its own; repeated rows each get the same result; an empty table gives an empty result; other columns
go along in ``document``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import let, salted_join, stored, without_spaces, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityLimits:
    """A line counts as boilerplate in more than ``line_documents`` documents of a host. A document is
    depleted with less than ``own_share`` of its words left. The base rules: ``least_words``, and at most ``repeat_percent`` words in repeated windows.
    """

    line_documents: int = 20
    own_share: float = 0.25
    least_words: int = 50
    repeat_percent: int = 50


def _repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, in a sort of the windows' hashes."""

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(
                p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )

    def starts_of_repeats(ordered: Column) -> Column:
        repeats = F.filter(
            ordered,
            lambda e, i: (F.get(ordered, i - 1)["h"] == e["h"])
            | (F.get(ordered, i + 1)["h"] == e["h"]),
        )
        return F.sort_array(F.transform(repeats, lambda e: e["p"]))

    def by_hash(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(
            covered(let(F.sort_array(pairs), starts_of_repeats))
        )

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    return F.when(F.size(tokens) < 3, 0).otherwise(let(windows(tokens), by_hash))


def _counts(text: Column) -> Column:
    """All counts within a document, from one split of its text."""
    lines = F.filter(F.split(text, "\n"), lambda x: without_spaces(x) != "")
    repeated_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    bare = F.translate(text, SYMBOLS, "")
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(without_spaces(text)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(bare)).cast("long").alias("n_symbols"),
            repeated_lines.cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def base_counts(docs: DataFrame, limits: QualityLimits) -> DataFrame:
    """(document, key, counts of its own text, base_failed) of rows with ``document`` and ``key``."""
    counted = docs.select("document", "key", _counts(F.coalesce(F.col("text"), F.lit(""))).alias("c"))
    n, repeats = F.col("c.n_words"), F.col("c.n_repeat_words")
    failed = (n < limits.least_words) | (100 * repeats > limits.repeat_percent * n)
    return counted.select("document", "key", "c.*", failed.alias("base_failed"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: its row, its document's key, its hash and its words."""
    flat = F.regexp_replace(
        F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " "
    )
    numbered = docs.select(
        "source", "text", "key", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row")
    )
    each = F.explode(F.split(flat, "\n")).alias("line")
    keyed = numbered.select("source", "key", "text_hash", "row", each).withColumn("line", F.trim("line"))
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return keyed.where("line <> ''").select(
        "source",
        "key",
        "text_hash",
        "row",
        F.xxhash64("line").alias("line_hash"),
        (spaces + 1).alias("line_words"),
    )


def frequent_lines(docs: DataFrame, limits: QualityLimits) -> DataFrame:
    """(source, line_hash) of the lines that are boilerplate. All counts are map-side sums."""
    having = _lines(docs).select("source", "line_hash", "text_hash").distinct()
    counted = having.groupBy("source", "line_hash").agg(F.count("*").alias("documents"))
    return counted.where(F.col("documents") > limits.line_documents).select("source", "line_hash")


def boilerplate_words(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, removed): words in frequent lines, for documents that have some.

    Summed for each row first, so that repeated rows do not add up.
    """
    # A line may be in a third of all documents: its rows are dealt over salts.
    found = salted_join(_lines(docs), frequent, ["source", "line_hash"], F.col("row"), "inner")
    rows = found.groupBy("key", "row").agg(F.sum("line_words").alias("removed"))
    return rows.groupBy("key").agg(F.max("removed").alias("removed"))


def quality_rules(
    docs: DataFrame,
    limits: QualityLimits = QualityLimits(),
    carried: Sequence[str] | None = None,
) -> DataFrame:
    """(document, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, own_words, base_failed,
    kept) for every row of ``docs`` (doc_id, source, text and others): ``document`` holds its columns, or
    those ``carried``; then come the counts of its own text, and the words left beside boilerplate.
    """
    columns = docs.columns if carried is None else carried
    # Rows that agree in doc_id, source and text have one result.
    key = F.struct("doc_id", "source", "text", *(F.col(c).isNull() for c in ("doc_id", "source", "text")))
    docs = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in columns)).alias("document"),
        "source",
        "text",
        F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("plumbline"), key).alias("b")).alias("key"),
    )
    frequent = stored(frequent_lines(docs, limits), "lines")
    removed = boilerplate_words(docs, frequent)
    removed = stored(removed.withColumnRenamed("key", "removed_key"), "removed")
    counted = base_counts(docs, limits)
    own = F.col("n_words") - F.coalesce(F.col("removed"), F.lit(0))
    kept = ~F.col("base_failed") & (own >= limits.own_share * F.col("n_words"))
    return counted.join(removed, F.col("key") == F.col("removed_key"), "left").select(
        "document",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        own.alias("own_words"),
        "base_failed",
        kept.alias("kept"),
    )
