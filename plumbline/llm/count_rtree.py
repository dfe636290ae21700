"""Near-duplicate documents: Jaccard similarity of word shingles, joined in packed R-trees of counts.

Shingles are hashed into groups, and a document is the point of its counts by group. The overlap of two
documents is at most the sum of the smaller coordinates, and that of two nodes of a tree at most the
same sum over the corners of their boxes; pairs that cannot reach the similarity are not looked at.
What survives is verified on the whole shingle sets.

One tree over all points would compare nearly all pairs, as counts of unrelated texts differ little. So there is a
tree for each shingle, over the documents that have it in their prefix: under one order of all
shingles, similar documents share one of their first n - ceil(0.75 n) + 1. The order puts shingles of few
documents first, so that a passage repeated in many documents gathers hardly any, and a shingle
that only one document has needs no tree. Nothing is lost by it: any order finds every pair.

Links are only needed between groups that are not connected yet, and the trees are searched from the leaves
up. Their points are packed, and in each leaf, then in each node above the leaves, a few points are compared with
the others that are not connected with them: neighbours in the order of counts are the likeliest links, and a
group of n copies is joined in some n steps and not in n * n. Then the recursion pairs nodes from the root
down, for links across what is still apart.

Defined cases: a text that is null or without words has no shingles, links with nothing and is its own
class; repeated rows and equal sets are one class; a missing doc_id counts only where no other is in
the class; an empty table gives an empty result; other columns are ignored. Sets are told apart by
128-bit hashes, of which 64 are a set's name.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.shingles import mixed, shingle_sets
from plumbline.llm.tables import salted_join, ship, stored
from plumbline.llm.tree import FANOUT, Side, leaf_pairs

BITMAP_BITS = 24
COARSE = 8  # coordinates of a node's box, each the sum of several groups


@dataclass(frozen=True)
class JaccardSettings:
    """Links have a similarity of ``percent`` or more, over shingles of ``width`` words.

    Efficiency only, results do not depend on these: ``groups`` of the count vectors of short texts;
    2 ** ``table_bits`` entries in the table of frequencies and 2 ** ``seen_bits`` bits that say which
    shingles two documents or more have; from 2 ** ``hot_level`` documents on,
    rows of a shingle are not gathered in one task; ``leaf`` points to a leaf; ``range_shingles`` to a
    range that one task counts; ``star`` comparisons with the same document in one task; ``stars`` points of
    each node, by level from the leaves, that are compared with its others before the join.
    """

    width: int = 5
    percent: int = 75
    groups: int = 64
    table_bits: int = 24
    seen_bits: int = 27
    hot_level: int = 6
    leaf: int = 32
    range_shingles: int = 1 << 20
    star: int = 512
    stars: tuple[int, ...] = (1, 8)


def document_sets(docs: DataFrame, settings: JaccardSettings) -> DataFrame:
    """(doc_id, text_hash, n, set_id, check, counts, coarse) for each row of ``docs``: the size of its
    set, the set's name and a second hash of it, its counts by group and sums of these.
    """

    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in shingle_sets(batch, settings.width):
                with np.errstate(over="ignore"):
                    check = mixed(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                counts = count_vector(s, settings.groups)
                coarse = folded(counts, COARSE).tolist()
                rows.append((len(s), _set_name(s), int(np.int64(check)), counts.tobytes(), coarse))
            yield pd.DataFrame(rows, columns=["n", "set_id", "check", "counts", "coarse"])

    schema = "n BIGINT, set_id BIGINT, check BIGINT, counts BINARY, coarse ARRAY<BIGINT>"
    sets = F.pandas_udf(describe, schema)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sets("text").alias("s"))
    some = F.col("s.n") > 0
    return rows.select(
        "doc_id",
        "text_hash",
        "s.n",
        F.when(some, F.col("s.set_id")).alias("set_id"),
        F.when(some, F.col("s.check")).alias("check"),
        "s.counts",
        "s.coarse",
    )


def _set_name(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.int64(mixed(shingles).sum(dtype=np.uint64)))


def _split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted 64-bit keys that fall into each of 2**bits ranges."""
    if not bits:
        yield 0, slice(0, len(keys))
        return
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        yield int(ranges[a]), slice(a, b)


@dataclass(frozen=True)
class Frequencies:
    """How many documents have a shingle, in two tables of fixed size that leading bits index.

    ``levels`` has the highest floor(log2(documents)) among an entry's shingles; a bit of ``seen`` is set if two
    documents or more have one of its shingles. A bit that is not set means one document, so the
    order of prefixes tells shingles apart that meet nothing, until most bits are set.
    """

    levels: np.ndarray
    seen: np.ndarray

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """Levels of shingles; 0 where one document alone has the shingle."""
        levels = self.levels[_leading(shingles, len(self.levels).bit_length() - 1)]
        at = _leading(shingles, len(self.seen).bit_length() + 2)
        bit = (self.seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return np.where(bit > 0, np.maximum(levels, 1), 0)


def _leading(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def frequency_table(docs: DataFrame, total: int, settings: JaccardSettings) -> Frequencies:
    """The frequencies of all shingles. The size of the tables is fixed, whatever the corpus. Tasks send
    sorted parts for each range of hashes, packed as differences, and get back one row for a range.
    """
    bits = min(settings.table_bits, max(0, int(total / settings.range_shingles)).bit_length())
    # Bits that are counted: enough for shingles to share one rarely.
    width = min(60, max(32, settings.table_bits, settings.seen_bits, total.bit_length() + 8))

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for s in shingle_sets(frame["text"], settings.width):
                held.append(s)
                size += len(s)
                if size >= settings.range_shingles:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(sets: list[np.ndarray]) -> pd.DataFrame:
        # A shingle of very many documents leaves a task once for each flush, with its number.
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        parts = list(_split(keys, bits))
        return pd.DataFrame(
            {
                "part": [p for p, _ in parts],
                "data": [pack_high(keys[at], width) for _, at in parts],
                "counts": [zlib.compress(n[at].astype("<u4").tobytes(), 1) for _, at in parts],
            }
        )

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_high(d) for d in frame["data"]])
        n = np.concatenate([np.frombuffer(zlib.decompress(c), dtype="<u4") for c in frame["counts"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.add.reduceat(n[order].astype(np.int64), first)
        many = n > 1
        shared = keys[first[many]]

        def places(leading: int) -> np.ndarray:
            at = (shared >> np.uint64(width - leading)).astype(np.int64)
            return at - (key[0] << (leading - bits))

        levels = np.zeros(1 << (settings.table_bits - bits), dtype=np.uint8)
        high = np.minimum(np.floor(np.log2(n[many])), 255).astype(np.uint8)
        np.maximum.at(levels, places(settings.table_bits), high)
        seen = np.zeros(1 << (settings.seen_bits - bits - 3), dtype=np.uint8)
        if len(shared):
            at = places(settings.seen_bits)  # ascending
            own = np.flatnonzero(np.diff(at >> 3, prepend=-1))
            seen[at[own] >> 3] = np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), own)
        packed = [zlib.compress(x.tobytes(), 1) for x in (levels, seen)]
        return pd.DataFrame({"part": [key[0]], "levels": packed[:1], "seen": packed[1:]})

    parts = docs.select("text").mapInPandas(collect, "part BIGINT, data BINARY, counts BINARY")
    rows = parts.groupBy("part").applyInPandas(count, "part BIGINT, levels BINARY, seen BINARY")
    levels = np.zeros((1 << bits, 1 << (settings.table_bits - bits)), dtype=np.uint8)
    seen = np.zeros((1 << bits, 1 << (settings.seen_bits - bits - 3)), dtype=np.uint8)
    # Bounded by the tables' fixed size; an iterator would run a job for each partition.
    for r in rows.collect():
        levels[r["part"]] = np.frombuffer(zlib.decompress(r["levels"]), dtype=np.uint8)
        seen[r["part"]] = np.frombuffer(zlib.decompress(r["seen"]), dtype=np.uint8)
    return Frequencies(levels.ravel(), seen.ravel())


def pack_high(keys: np.ndarray, width: int) -> bytes:
    """The leading ``width`` bits of sorted keys, as planes of the bytes of their differences."""
    high = keys >> np.uint64(64 - width)
    steps = np.diff(high, prepend=np.uint64(0))
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = [i for i in range(8) if planes[i].any()]
    head = bytes([len(used), *used])
    # Low planes are random; only those above compress.
    low = b"".join(planes[i].tobytes() for i in used[:1])
    rest = zlib.compress(b"".join(planes[i].tobytes() for i in used[1:]), 1)
    return len(steps).to_bytes(4, "little") + head + low + rest


def unpack_high(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    used = data[5 : 5 + data[4]]
    body = data[5 + data[4] :]
    planes = np.zeros((8, n), dtype=np.uint8)
    if used:
        planes[used[0]] = np.frombuffer(body[:n], dtype=np.uint8)
        rest = np.frombuffer(zlib.decompress(body[n:]), dtype=np.uint8).reshape(-1, n)
        for i, plane in zip(used[1:], rest, strict=True):
            planes[i] = plane
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def prefix(
    shingles: np.ndarray, table: Frequencies, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the order of levels and hashes, and their levels."""
    # A similar document has at least ceil(percent * n / 100) of them.
    size = len(shingles) - -(-percent * len(shingles) // 100) + 1
    levels = table.of(shingles)
    order = np.lexsort((shingles, levels))[:size]
    return shingles[order], levels[order]


def shared_prefixes(
    docs: DataFrame, table: Frequencies, total: int, settings: JaccardSettings
) -> DataFrame:
    """(shingle, set_id) of the shingles that two sets or more have in their prefixes; of hot ones
    also those that one set has. Others meet in ranges of hashes; hot ones pass through as rows, in
    groups of at most 512 documents of one flush of one task, so that no task gets all of one.
    """
    prefixes = total * (100 - settings.percent) // 100
    bits = max(0, int(prefixes / settings.range_shingles)).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = "part BIGINT, salt BIGINT, shingles BINARY, sizes BINARY, sets BINARY"

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels = shared.value
        # No other task has these salts, and each flush goes on where the last one ended.
        salts = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[int, list] = {0: [], 1: []}
        size = 0
        for frame in frames:
            for s in shingle_sets(frame["text"], settings.width):
                if not len(s):
                    continue
                first, level = prefix(s, levels, settings.percent)
                hot = level >= settings.hot_level
                # A shingle that one document has meets no other.
                met = ~hot & (level > 0)
                if met.any():
                    held[0].append((_set_name(s), np.sort(first[met])))
                if hot.any():
                    held[1].append((_set_name(s), first[hot]))
                size += int(met.sum() + hot.sum())
                if size >= settings.range_shingles:
                    yield from packed(held, salts)
                    held, size = {0: [], 1: []}, 0
        yield from packed(held, salts)

    def packed(held: dict[int, list], salts: Iterator[int]) -> Iterator[pd.DataFrame]:
        rows = []
        rare = held[0]
        if rare:
            cuts = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
            places: dict[int, list] = {}
            for name, part in rare:
                edges = [0, *np.searchsorted(part, cuts).tolist(), len(part)] if bits else [0, len(part)]
                for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    if a < b:
                        places.setdefault(p, []).append((name, part[a:b]))
            rows += [(p, 0, *as_bytes(found)) for p, found in places.items()]
        for at in range(0, len(held[1]), 512):
            rows.append((-1, next(salts), *as_bytes(held[1][at : at + 512])))
        if rows:
            yield pd.DataFrame(rows, columns=["part", "salt", "shingles", "sizes", "sets"])

    def as_bytes(found: list) -> tuple[bytes, bytes, bytes]:
        return (
            np.concatenate([p for _, p in found]).tobytes(),
            np.array([len(p) for _, p in found], dtype=np.uint32).tobytes(),
            np.array([n for n, _ in found], dtype=np.int64).tobytes(),
        )

    def meet(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in frame["shingles"]])
        sizes = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in frame["sizes"]])
        sets = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in frame["sets"]])
        sets = np.repeat(sets, sizes)
        if key[0] >= 0:
            order = np.lexsort((sets, keys))
            keys, sets = keys[order], sets[order]
            new = np.ones(len(keys), dtype=bool)  # equal sets count once
            new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
            keys, sets = keys[new], sets[new]
            same = keys[1:] == keys[:-1]
            some = np.zeros(len(keys), dtype=bool)
            some[1:] |= same
            some[:-1] |= same
            keys, sets = keys[some], sets[some]
        return pd.DataFrame({"shingle": keys.astype(np.int64), "set_id": sets})

    parts = docs.select("text").mapInPandas(collect, schema)
    met = parts.groupBy("part", "salt").applyInPandas(meet, "shingle BIGINT, set_id BIGINT")
    return met


def count_vector(shingles: np.ndarray, least: int) -> np.ndarray:
    """Counts by group, one byte each. The groups are a power of two, at least half as many as there are
    shingles, because counts of unrelated sets differ enough only while they are small.
    """
    groups = max(least, 1 << max(0, len(shingles) // 2 - 1).bit_length())
    while True:
        group = (shingles & np.uint64(groups - 1)).astype(np.int64)
        counts = np.bincount(group, minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts by fewer groups, along the last axis: each is a sum of finer ones."""
    shape = (*counts.shape[:-1], -1, groups)
    return counts.reshape(shape).sum(axis=-2, dtype=np.int64)


def overlap_bounds(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """For each pair of vectors the sum of the smaller coordinates, in the groups of the coarser one."""
    out = np.empty(len(x), dtype=np.int64)
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        if len(a) > len(b):
            a = folded(a, len(b))
        elif len(b) > len(a):
            b = folded(b, len(a))
        out[k] = np.minimum(a, b).sum(dtype=np.int64)
    return out


def points(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """(point, n, counts, coarse) of the sets that share a prefix shingle with another."""
    one = sets.where("set_id IS NOT NULL").groupBy("set_id")
    columns = ("n", "counts", "coarse")
    known = one.agg(*(F.any_value(c).alias(c) for c in columns))
    known = known.join(shared.select("set_id").distinct(), "set_id", "left_semi")
    return stored(known.select(F.col("set_id").alias("point"), *columns), "points")


def bounded(pairs: DataFrame, known: DataFrame, settings: JaccardSettings) -> DataFrame:
    """The pairs (a, b) whose counts leave room for similarity; boxes of one point each come first."""

    def side(name: str) -> DataFrame:
        return known.select(
            F.col("point").alias(name),
            F.col("n").alias(f"{name}_least"),
            F.col("n").alias(f"{name}_most"),
            F.col("counts").alias(f"{name}_counts"),
            *(F.get("coarse", F.lit(i)).alias(f"{name}_hi{i}") for i in range(COARSE)),
        )

    near = _may_match(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), settings)

    def overlaps(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in frames:
            vectors = ([np.frombuffer(c, dtype=np.uint8) for c in side] for side in (x, y))
            yield pd.Series(overlap_bounds(*vectors))

    overlap = F.pandas_udf(overlaps, "long")("a_counts", "b_counts")
    needed = settings.percent * (F.col("a_least") + F.col("b_least"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return rows.where((100 + settings.percent) * overlap >= needed).select("a", "b")


def _texts(docs: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """(set_id, text) of the sets in ``known``: the text of each set's first document.

    A bitmap of fixed size, of hashes of these documents' ids, keeps most others out of the shuffle.
    """
    firsts = (
        sets.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .join(known.select(F.col("point").alias("set_id")), "set_id", "left_semi")
        .select("set_id", "first.*")
        .withColumnsRenamed({"doc_id": "first_id", "text_hash": "first_hash"})
    )
    firsts = stored(firsts, "firsts")
    bitmap = hash_bitmap(firsts.select(F.xxhash64("first_hash")))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def listed(hashes: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in hashes:
            at = bitmap_places(x.to_numpy())
            yield pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    some = hashed.where(F.pandas_udf(listed, "boolean")(F.xxhash64("text_hash")))
    on = F.col("doc_id").eqNullSafe(F.col("first_id")) & (
        F.col("text_hash") == F.col("first_hash")
    )
    texts = some.join(firsts, on).select("set_id", "text")
    return stored(texts.dropDuplicates(["set_id"]), "texts")


def verified(pairs: DataFrame, texts: DataFrame, settings: JaccardSettings) -> DataFrame:
    """Those of the pairs (a, b) that are links. The partners of ``a`` stream past its set, in
    salted parts if there are many; a task holds one set beside the one it compares.
    """
    salt = F.pmod(F.xxhash64("b"), F.col("parts"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / settings.star).alias("parts"))
    partners = (
        pairs.join(sizes, "a")
        .select("a", salt.alias("salt"), "b")
        .join(texts, F.col("b") == F.col("set_id"))
        .select("a", "salt", "b", "text")
    )
    centers = (
        sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .join(texts, F.col("a") == F.col("set_id"))
        .select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    )
    rows = centers.unionByName(partners).repartition("a", "salt")
    rows = rows.select(
        "a", "salt", F.col("b").isNotNull().alias("is_partner"), F.coalesce("b", "a").alias("b"), "text"
    ).sortWithinPartitions("a", "salt", "is_partner")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        center = None
        for frame in frames:
            found = []
            kinds = zip(frame["a"], frame["b"], frame["is_partner"], strict=True)
            for (a, b, is_partner), s in zip(kinds, shingle_sets(frame["text"], settings.width), strict=True):
                if not is_partner:
                    center = s
                    continue
                common = len(np.intersect1d(center, s, assume_unique=True))
                union = len(center) + len(s) - common
                if 100 * common >= settings.percent * union:
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows.select("a", "b", "is_partner", "text").mapInPandas(compare, "a BIGINT, b BIGINT")


def _may_match(a: Side, b: Side, settings: JaccardSettings) -> Column:
    """Whether boxes of counts leave room for a pair that is similar."""
    overlap = F.lit(0)
    for i in range(COARSE):
        overlap = overlap + F.least(a(f"hi{i}"), b(f"hi{i}"))
    sizes = (100 * a("most") >= settings.percent * b("least")) & (
        100 * b("most") >= settings.percent * a("least")
    )
    needed = settings.percent * (a("least") + b("least"))
    return sizes & ((100 + settings.percent) * overlap >= needed)


def open_trees(shared: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(shingle, set_id, root) of the trees whose members are not all connected yet."""
    members = shared.withColumn("root", F.col("set_id"))
    if roots is not None:
        named = shared.join(roots, F.col("set_id") == F.col("node"), "left")
        members = named.select("shingle", "set_id", F.coalesce("root", "set_id").alias("root"))
    apart = members.groupBy(F.col("shingle").alias("open")).agg(
        F.min("root").alias("r0"), F.max("root").alias("r1")
    )
    apart = apart.where("r0 <> r1").select("open")
    return members.join(apart, F.col("shingle") == F.col("open")).drop("open")


def node_stars(members: DataFrame, known: DataFrame, turn: int, settings: JaccardSettings) -> DataFrame:
    """Distinct pairs (a, b) of a few points of a node with its others that are not connected with them.

    Points of a tree are packed in the order of their sizes and counts. The nodes are the leaves in the first turn,
    with their first point, and those ``turn`` levels higher after it, with as many points as ``stars`` says, evenly
    from the node. Ranges of the order go to tasks, so that no task packs all of a large tree, and each
    tree begins its first node at another place, so that nodes of trees over the same points overlap.
    """
    size, stars = settings.leaf * FANOUT**turn, settings.stars[turn]
    # Sizes first, then for each coarse group its share of the set in eighths.
    place = F.shiftleft("n", 3 * COARSE)
    for i in range(COARSE):
        share = F.floor(F.get("coarse", F.lit(i)) * 8 / (F.col("n") + 1)).cast("long")
        place = place + F.shiftleft(share, 3 * (COARSE - 1 - i))
    spots = known.select("point", place.alias("place"))
    order = ["shingle", "place", "set_id"]
    placed = members.join(spots, F.col("set_id") == F.col("point"))
    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["shingle", "set_id", "root"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, position = np.empty((0, 3), dtype=np.int64), 0
        for frame in itertools.chain(frames, [None]):
            rows = held if frame is None else np.concatenate([held, frame[names].to_numpy()])
            if not len(rows):
                continue
            trees, at = rows[:, 0], np.arange(len(rows))
            begins = np.ones(len(rows), dtype=bool)
            begins[1:] = trees[1:] != trees[:-1]
            run = np.maximum.accumulate(np.where(begins, at, 0))
            shift = (trees.view(np.uint64) >> np.uint64(17)).astype(np.int64) % size
            # The first tree may go on from the frame before, where a node of it ended.
            slot = np.where((run == 0) & (position > 0), position + at, at - run + shift)
            node = np.cumsum(begins | (slot % size == 0)) - 1
            whole = len(rows) if frame is None else int(np.searchsorted(node, node[-1]))
            held, position = rows[whole:], int(slot[whole]) if whole < len(rows) else 0
            yield from _star_pairs(rows[:whole], node[:whole], stars)

    return packed.select(*names).mapInPandas(cut, "a BIGINT, b BIGINT").distinct()


def _star_pairs(rows: np.ndarray, node: np.ndarray, stars: int) -> Iterator[pd.DataFrame]:
    """Pairs of ``stars`` rows of each node, evenly from it, with those of its rows that have other roots."""
    if not len(rows):
        return
    first = np.searchsorted(node, np.arange(node[-1] + 1))
    sizes = np.diff(first, append=len(rows))
    for k in range(stars):
        # A node of fewer rows than stars has each row once.
        star = first + (k * sizes // stars if stars > 1 else 0)
        again = (k * sizes // stars == (k - 1) * sizes // stars) & (k > 0)
        a = rows[star[node]]
        apart = (a[:, 2] != rows[:, 2]) & ~again[node]
        if apart.any():
            yield pd.DataFrame({"a": a[apart, 1], "b": rows[apart, 1]})


def tree_pairs(
    shared: DataFrame, known: DataFrame, roots: DataFrame | None, settings: JaccardSettings
) -> DataFrame:
    """Distinct pairs (a, b) of sets that share a prefix shingle, are not connected yet and pass the bound
    of their counts.
    """
    members = open_trees(shared, roots)
    # Trees over the same sets have the same pairs; of those, the one of the least shingle is searched.
    names = members.groupBy("shingle").agg(
        F.count("*").alias("size"),
        F.sum(F.xxhash64("set_id").cast("decimal(38,0)")).alias("same"),
    )
    once = names.groupBy("size", "same").agg(F.min("shingle").alias("tree"))
    members = members.join(once, F.col("shingle") == F.col("tree")).drop("shingle")
    members = stored(members, "members")
    # A pair is taken from the least tree that it shares: a point knows its trees before each.
    own = members.groupBy("set_id").agg(F.collect_list("tree").alias("trees"))
    members = members.join(own, "set_id")
    earlier = F.filter("trees", lambda t: t < F.col("tree")).alias("earlier")
    placed = members.join(known, F.col("set_id") == F.col("point"))
    coarse = [F.get("coarse", F.lit(i)).alias(f"c{i}") for i in range(COARSE)]
    placed = stored(placed.select("tree", "size", "set_id", "root", earlier, "n", "counts", *coarse), "placed")
    # Packing: points by size and then by their counts, a leaf's worth of neighbours to a leaf. Large trees
    # are ordered in strips of sizes, so that no task orders a whole tree.
    strip = F.when(F.col("size") > 64 * settings.leaf, F.floor(F.log2("n") * 16)).otherwise(0)
    placed = placed.withColumn("strip", strip.cast("int"))
    order = Window.partitionBy("tree", "strip").orderBy("n", *(f"c{i}" for i in range(COARSE)), "set_id")
    slot = F.floor((F.row_number().over(order) - 1) / settings.leaf)
    packed = placed.withColumn("slot", slot)
    sides = {f"hi{i}": F.max(f"c{i}") for i in range(COARSE)}
    rows = F.collect_list(F.struct("set_id", "root", "earlier", "n", "counts"))
    leaves = packed.groupBy("tree", "strip", "slot").agg(
        rows.alias("rows"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        *(c.alias(n) for n, c in sides.items()),
    )
    number = F.row_number().over(Window.partitionBy("tree").orderBy("strip", "slot")) - 1
    leaves = stored(leaves.withColumn("leaf", number.cast("long")), "leaves")
    box = {"least": F.min, "most": F.max} | {n: F.max for n in sides}
    pairs = leaf_pairs(leaves, ["tree"], box, lambda a, b: _may_match(a, b, settings))

    def side(name: str) -> DataFrame:
        return leaves.select(
            F.col("tree").alias(f"{name}_tree"),
            F.col("leaf").alias(f"{name}_leaf"),
            F.col("rows.set_id").alias(f"{name}_sets"),
            F.col("rows.root").alias(f"{name}_roots"),
            F.col("rows.earlier").alias(f"{name}_earlier"),
            F.col("rows.n").alias(f"{name}_n"),
            F.col("rows.counts").alias(f"{name}_counts"),
        )

    # A pair of leaves is little to read and much to compute, so the number of tasks is told, not sized.
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name in ("a", "b"):
        on = (F.col("tree") == F.col(f"{name}_tree")) & (F.col(name) == F.col(f"{name}_leaf"))
        dealt = side(name).repartition(tasks, f"{name}_tree", f"{name}_leaf")
        pairs = pairs.repartition(tasks, "tree", name).join(dealt, on)
        pairs = pairs.drop(f"{name}_tree", f"{name}_leaf")

    def survive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for r in frame.itertuples(index=False):
                x, y = ([np.frombuffer(c, dtype=np.uint8) for c in cs] for cs in (r.a_counts, r.b_counts))
                n, m = np.asarray(r.a_n)[:, None], np.asarray(r.b_n)[None, :]
                apart = np.asarray(r.a_roots)[:, None] != np.asarray(r.b_roots)[None, :]
                needed = settings.percent * (n + m)
                # First in few groups, all pairs at once; what is left one by one in all groups.
                u, v = (np.stack([folded(c, settings.groups) for c in cs]) for cs in (x, y))
                rough = np.zeros(apart.shape, dtype=np.int64)
                for g in range(settings.groups):
                    rough += np.minimum(u[:, g, None], v[None, :, g])
                i, j = np.nonzero(apart & ((100 + settings.percent) * rough >= needed))
                exact = overlap_bounds([x[k] for k in i], [y[k] for k in j])
                fits = np.flatnonzero((100 + settings.percent) * exact >= needed[i, j])
                left = {k: set(r.a_earlier[k]) for k in i[fits].tolist()}
                for k in fits.tolist():
                    a, b = r.a_sets[i[k]], r.b_sets[j[k]]
                    if left[i[k]].isdisjoint(r.b_earlier[j[k]]) and (r.a < r.b or a < b):
                        found.append((min(a, b), max(a, b)))
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return pairs.mapInPandas(survive, "a BIGINT, b BIGINT")


@dataclass(frozen=True)
class Links:
    """The rows' sets, and links (a, b) between sets: those found within nodes of the trees, those found by
    the join of their nodes, and ``edges`` that connect the same sets as all of them.
    """

    sets: DataFrame
    within: DataFrame | None
    join: DataFrame
    edges: DataFrame


def jaccard_links(docs: DataFrame, settings: JaccardSettings = JaccardSettings()) -> Links:
    """Links that connect all sets that are linked."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sets = stored(document_sets(docs, settings), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    table = frequency_table(docs, total, settings)
    shared = stored(shared_prefixes(docs, table, total, settings).distinct(), "shared")
    known = points(sets, shared)
    texts = _texts(docs, sets, known)
    within, tried, roots, stars = None, None, None, None
    for turn in range(len(settings.stars)):
        pairs = bounded(node_stars(open_trees(shared, roots), known, turn, settings), known, settings)
        pairs = stored(pairs, "pairs")
        found = stored(verified(pairs, texts, settings), "links")
        within = found if within is None else within.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        # Chains of leaves are long, so they are followed to their ends.
        roots = stored(components(found if stars is None else stars.unionByName(found)), "roots")
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = tree_pairs(shared, known, roots, settings)
    if tried is not None:
        both = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = more.join(both, ["a", "b"], "left_anti")
    join = stored(verified(stored(more, "pairs"), texts, settings), "links")
    return Links(sets, within, join, join if stars is None else stars.unionByName(join))


def near_documents(docs: DataFrame, settings: JaccardSettings = JaccardSettings()) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, class_id): a row for each row of ``docs``. The
    class_id names the class where doc_id is missing; it is missing without shingles.
    """
    links = jaccard_links(docs, settings)
    sets = links.sets
    roots = components(links.edges)
    firsts = sets.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    placed = firsts.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "first_id", F.coalesce("root", "set_id").alias("root")
    )
    placed = stored(placed, "classes")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = salted_join(placed, least, ["root"], F.col("set_id"))
    classes = classes.select("set_id", "component_id", F.col("root").alias("class_id"))
    # Rows without shingles stay out of the join, so that they do not meet under one key.
    named = salted_join(sets.where("set_id IS NOT NULL"), classes, ["set_id"], F.col("doc_id"))
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "class_id"]
    alone = sets.where("set_id IS NULL").withColumns(
        {"component_id": F.col("doc_id"), "class_id": F.lit(None).cast("bigint")}
    )
    return named.select(*columns).unionByName(alone.select(*columns))


def first_of_each_class(
    docs: DataFrame, settings: JaccardSettings = JaccardSettings()
) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the least doc_id; of equal ids, that
    with the least hash of its text, and of equal rows one. Rows without shingles all stay.

    Rows are known by a hash of doc_id and text. Most are the only ones of their class and stay where they
    are: a bitmap of fixed size, of the hashes of all others, tells them, and what it holds is dealt
    once by that hash, for the join with the rows to keep and for the choice among equal rows.
    """
    near = near_documents(docs.select("doc_id", "text"), settings).where("n_shingles > 0")
    hashed = near.select("doc_id", "text_hash", "class_id", _row_key(F.col("text_hash")).alias("key"))
    hashed = stored(hashed, "near")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "key")
    # (class, rows, key to keep): equal rows and rows of one class are summed before they meet.
    classes = hashed.groupBy("class_id").agg(F.min(least).alias("first"), F.count("*").alias("n"))
    classes = stored(classes.select("class_id", F.col("first.key").alias("first_key"), "n"), "classes")
    shared = classes.where("n > 1")
    touched = salted_join(hashed, shared, ["class_id"], F.col("key"), "inner")
    bitmap = hash_bitmap(touched.select(F.xxhash64("key")))
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def listed(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in keys:
            at = bitmap_places(x.to_numpy())
            yield pd.Series((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("document"), _row_key(F.xxhash64("text")).alias("key"))
    # Of the rows that the bitmap holds, those without shingles or alone in their class stay too.
    has_word = F.coalesce(F.col("document.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met = keyed.withColumn("met", has_word & F.pandas_udf(listed, "boolean")(F.xxhash64("key")))
    alone = met.where("NOT met").select("document.*")
    first = classes.select(F.col("first_key").alias("key"))
    one = met.where("met").groupBy("key").agg(F.min_by("document", F.xxhash64("document")).alias("document"))
    kept = one.join(first, "key", "left_semi").select("document.*")
    return alone.unionByName(kept)


def _row_key(text_hash: Column) -> Column:
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("none"))
    return F.concat_ws(":", F.hex(text_hash), name)


def bitmap_places(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.int64) & ((1 << BITMAP_BITS) - 1)


def hash_bitmap(hashes: DataFrame) -> np.ndarray:
    """2 ** ``BITMAP_BITS`` bits, of which those of the hashes in the first column are set."""
    spot = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1  # counted from 1
    pages = (
        hashes.groupBy(F.bitmap_bucket_number(spot).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
        .collect()  # bounded by the size of the bitmap
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    for r in pages:  # pages are numbered from 1
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bitmap[(r["page"] - 1) * len(part) :][: len(part)] = part
    return bitmap
