"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

A source's documents, in a shuffled order, form one stream of words that is cut into blocks of equal
length; the stream starts again when the source gives more than it has. The mix is a sequence of slots. Slot
k has the golden-ratio point frac(k * 0.618...), which the cumulative targets map to a source, so that every stretch
of the mix holds the sources in their shares. The slots of a source are ranked, and slot rank r
takes block r.

Defined cases: a text that is null or without words has size 0 and gives nothing; a missing source is a
source of its own, last in order; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored, or go along in ``document``, whatever their names. Order within a
source follows the MD5 of doc_id and a seed, so reruns agree; a missing doc_id counts as the text "null".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import SPACES, n_words, running, salted_join, stored

GOLDEN = (5**0.5 - 1) / 2
# k * GOLDEN loses its fraction in double precision for large k, so k is split at 2**26.
HIGH = 2**26


@dataclass(frozen=True)
class MixSettings:
    """``weights`` go to the sources by code point, repeating. The mix has ``share`` times all words;
    no source gives more than ``repeats`` times its own. ``block`` is in words. ``bucket_rows`` and
    ``chunk_slots`` bound what one task orders at a time.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    block: int = 256
    seed: str = "mix"
    bucket_rows: int = 2048
    chunk_slots: int = 1 << 17


def _sources(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """(source, source_id, source_size, documents, target, length): targets with the excess of full
    sources dealt again by weight. Each round is one small aggregate over the sources.
    """
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("documents")
    )
    by_code_point = [F.col("source").isNull(), F.col("source")]
    ranked = running(totals, by_code_point, {}, "source_id")
    weights = F.array(*(F.lit(w) for w in settings.weights))
    place = (F.col("source_id") % len(settings.weights)).cast("int")
    ranked = stored(ranked.withColumn("weight", F.get(weights, place)), "sources")
    most = F.col("source_size") * float(settings.repeats)
    whole = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = settings.share * (whole[0] or 0)
    level = wanted / whole[1] if whole[1] else 0.0
    while True:
        full = most < F.col("weight") * level
        given, rest = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)),
            F.sum(F.when(~full, F.col("weight"))),
        ).first()
        if not rest:
            break
        higher = (wanted - settings.repeats * given) / rest
        if higher <= level:
            break
        level = higher
    target = F.least(most, F.col("weight") * level)
    return ranked.withColumn("target", target).withColumn("length", F.floor("target"))


def _streams(sized: DataFrame, sources: DataFrame, settings: MixSettings) -> DataFrame:
    """The documents with ``start``, their place in their source's stream, and ``ord``, their rank.

    Sums run inside buckets of the shuffled order and are shifted by the buckets before.
    """
    known = sources.select("source", "source_id", "source_size", "documents", "target", "length")
    docs = salted_join(sized, known, ["source"], F.col("doc_id"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    mixed = F.md5(F.concat(name, F.lit(f":{settings.seed}")))
    head = F.conv(F.substring(mixed, 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("documents") / settings.bucket_rows)
    docs = docs.withColumn("mixed", mixed).withColumn(
        "bucket", F.shiftright(head * buckets, 32).cast("long")
    )
    docs = stored(docs, "streams")
    totals = docs.groupBy("source_id", "bucket").agg(
        F.sum("size").alias("t_size"), F.count("*").alias("t_rows")
    )
    before = (
        Window.partitionBy("source_id")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = totals.select(
        "source_id",
        "bucket",
        F.coalesce(F.sum("t_size").over(before), F.lit(0)).alias("b_size"),
        F.coalesce(F.sum("t_rows").over(before), F.lit(0)).alias("b_rows"),
    )
    inside = Window.partitionBy("source_id", "bucket").orderBy("mixed", "doc_id", "size")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.select(
        "*",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("i_size"),
        (F.row_number().over(inside) - 1).alias("i_rows"),
    )
    return placed.join(shifts, ["source_id", "bucket"]).select(
        "doc_id",
        "source_id",
        "size",
        "source_size",
        "target",
        "length",
        (F.col("i_size") + F.col("b_size")).alias("start"),
        (F.col("i_rows") + F.col("b_rows")).alias("ord"),
    )


def _point(k: Column) -> Column:
    high, low = F.floor(k / HIGH), k % HIGH
    x = high * (HIGH * GOLDEN % 1.0) + low * GOLDEN
    return x - F.floor(x)


def slot_schedule(sources: DataFrame, settings: MixSettings) -> DataFrame:
    """(slot, source_id, rank): the slots of the mix. Each source gets ceil(length / block) ranks;
    what the points leave short of that, a few slots a source, follows at the end.
    """
    spark = sources.sparkSession
    need = sources.select(
        "source_id", "length", F.ceil(F.col("length") / settings.block).alias("slots")
    )
    total, n_slots, n_sources = need.agg(
        F.sum("length"), F.sum("slots"), F.count(F.lit(1))
    ).first()
    total, n_slots = total or 0, n_slots or 0
    # Points meet sources in cells: the pairs of a slot and a source stay near the number of slots,
    # however many sources there are.
    cells = 256
    while cells < 4 * n_sources:
        cells *= 2
    order = [F.col("source_id")]
    spans = running(need, order, {"low": "length"}, "_rank").drop("_rank")
    cell = lambda x: F.floor(x / float(max(total, 1)) * cells)
    high = F.col("low") + F.col("length")
    spans = spans.where("length > 0").select(
        "source_id",
        "slots",
        "low",
        high.alias("high"),
        F.explode(F.sequence(cell(F.col("low")), cell(high))).alias("cell"),
    )
    points = spark.range(n_slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    points = points.select(
        "slot",
        (F.col("u") * float(total)).alias("x"),
        F.floor(F.col("u") * cells).alias("point_cell"),
    )
    inside = (
        (F.col("point_cell") == F.col("cell"))
        & (F.col("x") >= F.col("low"))
        & (F.col("x") < F.col("high"))
    )
    chunk = F.floor(F.col("slot") / settings.chunk_slots).alias("chunk")
    dealt = points.join(spans, inside).select("slot", "source_id", "slots", chunk)
    dealt = stored(dealt, "slots")
    counts = dealt.groupBy("source_id", "chunk").agg(F.count("*").alias("n"))
    before = (
        Window.partitionBy("source_id")
        .orderBy("chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(
        "source_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("source_id", "chunk").orderBy("slot")
    ranked = (
        dealt.withColumn("row", F.row_number().over(within) - 1)
        .join(shifts, ["source_id", "chunk"])
        .withColumn("rank", F.col("row") + F.col("before"))
        .where("rank < slots")
        .select("slot", "source_id", "rank")
    )
    have = counts.groupBy("source_id").agg(F.sum("n").alias("have"))
    short = (
        need.join(have, "source_id", "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .where("have < slots")
        .withColumn("rank", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)))
    )
    late = F.lit(n_slots) + (F.col("rank") - F.col("have")) * n_sources + F.col("source_id")
    return ranked.unionByName(short.select(late.alias("slot"), "source_id", "rank"))


def mix(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mix as pieces of documents: (doc_id, source_id, ord, size, source_size, target, epoch,
    first, n, slot). A piece is ``n`` words from word ``first`` of the document that is ``ord``-th in
    its source's stream; slots give the order of the mix. Documents that give nothing have one row
    without a slot.
    """
    sized = stored(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes"
    )
    sources = stored(_sources(sized, settings), "targets")
    streams = _streams(sized, sources, settings)
    epochs = streams.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(settings.repeats - 1)))
    )
    begin = F.col("epoch") * F.col("source_size") + F.col("start")
    epochs = epochs.withColumn("begin", begin).withColumn(
        "end", F.least(F.col("begin") + F.col("size"), F.col("length"))
    )
    block = F.lit(settings.block)
    ranks = F.when(
        F.col("begin") < F.col("end"),
        F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)),
    )
    pieces = epochs.withColumn("piece", F.explode_outer(ranks))
    first = F.greatest(F.col("begin"), F.col("piece") * block)
    last = F.least(F.col("end"), (F.col("piece") + 1) * block)
    pieces = pieces.select(
        "doc_id",
        "source_id",
        "ord",
        "size",
        "source_size",
        "target",
        "epoch",
        (first - F.col("begin")).alias("first"),
        (last - first).alias("n"),
        "piece",
    )
    slots = slot_schedule(sources, settings).select(
        F.col("source_id").alias("slot_source"), F.col("rank"), "slot"
    )
    on = (F.col("source_id") == F.col("slot_source")) & (F.col("piece") == F.col("rank"))
    # There are as many slots as pieces, but their file is a small part of their size in a broadcast.
    return pieces.join(slots.hint("merge"), on, "left").drop("slot_source", "rank", "piece")


def taken_words(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot and n_slots, a row for each document, summed
    from the mix: the words that it takes, the first slot that holds some, and in how many slots they are.
    """
    one = ["source_id", "ord", "doc_id", "size", "source_size", "target"]
    placed = F.when(F.col("slot").isNotNull(), F.col("n"))
    return (
        mix(docs, settings)
        .groupBy(*one)
        .agg(
            F.coalesce(F.sum(placed), F.lit(0)).alias("taken"),
            F.min("slot").alias("first_slot"),
            F.count("slot").alias("n_slots"),
        )
        .select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
    )


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(document, slot): ``docs`` as the mix has them, in the order of the first slot of each pass.

    ``document`` holds a row's columns, once for each pass of its source's stream. The pass at which
    a source has given its words is cut there: its text ends with the last word taken, so every source
    comes out at its target. Rows that agree in all columns share one text.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*columns)
    missing = F.struct(*(c.isNull() for c in columns))  # a hash passes over what is missing
    key = F.concat(F.hex(F.xxhash64(row, missing)), F.hex(F.xxhash64(F.lit(settings.seed), row, missing)))
    keyed = docs.select(key.alias("row_key"), "source", "text", row.alias("document"))
    named = keyed.select(F.col("row_key").alias("doc_id"), "source", "text")
    passes = (
        mix(named, settings)
        .where("slot IS NOT NULL")
        .groupBy("source_id", "ord", "doc_id", "size", "epoch")
        .agg(F.sum("n").alias("taken"), F.min("slot").alias("slot"))
        .select(F.col("doc_id").alias("key"), "size", "taken", "slot")
    )
    passes = stored(passes, "passes")
    # Equal rows become one in each task before they are dealt, and the join takes them as dealt.
    texts = keyed.select(F.col("row_key").alias("key"), "document").dropDuplicates(["key"])
    rows = texts.join(passes, "key")
    start = _first_words(F.col("document.text"), F.col("taken"))
    cut = F.when(F.col("taken") < F.col("size"), F.col("document").withField("text", start))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withField("n_chars", F.length(start).cast(kind))
    ordered = rows.select(F.coalesce(cut, F.col("document")).alias("document"), "slot")
    return ordered.repartitionByRange("slot").sortWithinPartitions("slot")


def _first_words(text: Column, n: Column) -> Column:
    """The text up to its ``n``-th word, with the spaces before the words."""
    word = rf"(?:{SPACES})?{SPACES.replace('[', '[^')}"
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(word), F.lit(0)), 1, n.cast("int")), "")
