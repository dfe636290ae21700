"""Best-fit packing into bins of several permitted lengths.

Documents longer than the longest length are cut; full pieces are bins by themselves. The other pieces
are dealt over shards of bounded size, and each shard is packed best-fit decreasing: a piece goes
into the open bin with the least room that holds it. Where none does, the length to open is the one whose cost
(its tokens and a fixed cost for the sequence) per token is least when it is filled greedily with
the pieces that are left. At the end every bin shrinks to the shortest length that holds its
contents.

Defined cases: a text that is null or without words has one row without a bin; repeated rows are separate
documents; a missing doc_id is an id like any other; an empty table gives an empty result; other columns
are ignored, whatever their names.

``pack`` tells where the words of a document go; ``pack_texts`` gives the words too.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import SPACES, let, n_words, ship, stored, without_spaces

# A word with the spaces before it, and with those behind it at the end of the text.
TOKEN = rf"(?:{SPACES})?{SPACES.replace('[', '[^')}(?:{SPACES}\z)?"


@dataclass(frozen=True)
class PackSettings:
    """Permitted ``lengths`` in words, what each sequence costs besides its length, and how many pieces
    a shard has on average.
    """

    lengths: tuple[int, ...] = (512, 1024, 2048, 4096)
    sequence_cost: int = 64
    shard_pieces: int = 8192


class _Left:
    """Pieces that are not packed yet: how many of each size, and the sizes in order."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.order.pop(bisect.bisect_left(self.order, size))

    def fill(self, room: int) -> int:
        """Words that pieces of decreasing size bring into ``room``."""
        filled, at = 0, bisect.bisect_right(self.order, room)
        while at and room >= self.order[0]:
            size = self.order[at - 1]
            n = min(self.count[size], room // size)
            filled, room = filled + n * size, room - n * size
            at = min(at - 1, bisect.bisect_right(self.order, room))
        return filled


def pack_shard(
    sizes: Sequence[int], lengths: Sequence[int], sequence_cost: int
) -> tuple[list[int], list[int], list[int]]:
    """Packs sizes in decreasing order. Returns each piece's bin and offset, and the bins' lengths."""
    lengths = sorted(lengths)
    left = _Left(sizes)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[int] = []
    offsets: list[int] = []
    used: list[int] = []
    opened: list[int] = []

    def put(bin_no: int, size: int) -> None:
        bins.append(bin_no)
        offsets.append(used[bin_no])
        used[bin_no] += size
        room = opened[bin_no] - used[bin_no]
        if room:
            if room not in by_room:
                bisect.insort(rooms, room)
            by_room.setdefault(room, []).append(bin_no)

    for size in sizes:
        left.take(size)
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            bin_no = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            able = [c for c in lengths if c >= size]
            cost = {c: (c + sequence_cost) / (size + left.fill(c - size)) for c in able}
            bin_no = len(opened)
            opened.append(min(able, key=lambda c: (cost[c], c)))
            used.append(0)
        put(bin_no, size)
    final = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return bins, offsets, final


def pack(
    docs: DataFrame, settings: PackSettings = PackSettings(), carried: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, size, piece, first, n, bin_id, bin_offset, bin_length): a row for each piece, with the
    small columns of its document that are ``carried`` along.

    Bin ids are texts: the shard and the bin's number in it, or "full" and the piece's name.
    """
    ship(docs.sparkSession)
    longest = max(settings.lengths)
    sized = stored(docs.select("doc_id", *carried, n_words(F.col("text")).alias("size")), "sizes")
    whole = F.floor(F.col("size") / longest).cast("int")
    pieces = sized.withColumn(
        "piece",
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / longest) - 1).cast("int"))),
    )
    first = F.col("piece").cast("long") * longest
    pieces = pieces.select(
        "doc_id",
        *carried,
        "size",
        "piece",
        first.alias("first"),
        F.least(F.lit(longest).cast("long"), F.col("size") - first).alias("n"),
        (F.col("piece") < whole).alias("is_full"),
        F.monotonically_increasing_id().alias("row"),
    )
    pieces = stored(pieces, "pieces")
    # Numbers of stored rows do not change when a task runs again.
    full = pieces.where("is_full").select(
        "doc_id",
        *carried,
        "size",
        "piece",
        "first",
        "n",
        F.concat(F.lit("full-"), F.col("row").cast("string")).alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"),
        F.lit(longest).cast("long").alias("bin_length"),
    )
    nothing = pieces.where("n = 0").select(
        "doc_id",
        *carried,
        "size",
        "piece",
        "first",
        "n",
        F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_offset"),
        F.lit(None).cast("long").alias("bin_length"),
    )
    parts = pieces.where("n > 0 AND NOT is_full")
    shards = max(1, -(-parts.count() // settings.shard_pieces))
    # Integers beside missing ones would come as doubles and lose digits.
    sharded = parts.select(
        *(F.col(c).cast("string").alias(c) for c in ("doc_id", *carried)),
        "size",
        "piece",
        "first",
        "n",
        F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).alias("shard"),
    )

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "doc_id", "piece"], ascending=[False, True, True])
        bins, offsets, lengths = pack_shard(
            frame["n"].tolist(), settings.lengths, settings.sequence_cost
        )
        out = frame[["doc_id", *carried, "size", "piece", "first", "n"]].copy()
        out["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        out["bin_offset"] = offsets
        out["bin_length"] = [lengths[b] for b in bins]
        return out

    kinds = {f.name: "string" if f.name in ("doc_id", *carried) else f.dataType.simpleString() for f in full.schema}
    best = sharded.groupBy("shard").applyInPandas(packed, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    best = best.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in full.schema))
    return best.unionByName(full).unionByName(nothing)


def _cut(text: Column, longest: int) -> Column:
    """(piece, text) of each piece of ``longest`` words, with the spaces before them; the last piece has
    those at the end too. A text without words is one piece.
    """

    def pieces(tokens: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (F.ceil(F.size(tokens) / longest) - 1).cast("int")),
            lambda i: F.struct(
                i.alias("piece"),
                F.array_join(F.slice(tokens, i * longest + 1, longest), "").alias("text"),
            ),
        )

    whole = F.array(F.struct(F.lit(0).alias("piece"), text.alias("text")))
    no_words = F.coalesce(without_spaces(text) == "", F.lit(True))
    return F.when(no_words, whole).otherwise(
        let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), pieces)
    )


def pack_texts(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """``pack`` with the ``text`` of each piece; the pieces of a document add up to its whole text.

    Only sizes are packed. The pieces then fetch their texts by document and piece, a document being its
    doc_id and a hash of its text, which holds however the rows are read again; copies share one text.
    Equal pieces are made one in each task before they are dealt, and the join takes them as dealt.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("none"))
    key = F.concat_ws(":", F.hex(F.xxhash64("text")), name)
    keyed = docs.select("doc_id", "text", key.alias("document"))
    placed = pack(keyed, settings, ("document",))
    each = F.inline(_cut(F.col("text"), max(settings.lengths)))
    cut = keyed.select(F.col("document").alias("cut_document"), each)
    cut = cut.withColumnRenamed("piece", "cut_piece").dropDuplicates(["cut_document", "cut_piece"])
    on = (F.col("document") == F.col("cut_document")) & (F.col("piece") == F.col("cut_piece"))
    return placed.join(cut, on, "left").drop("document", "cut_document", "cut_piece")
