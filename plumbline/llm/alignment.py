"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

For a text, matrix A has a row for each token of the first tokenizer with ones at the bytes it covers, B
likewise. The rows of A·Bᵀ are the overlap links, their values the shared bytes. Where an overlap ends with both
of its tokens, the text is cut into groups; the group incidences of both sides multiply to the
shared-group links, whose rows are made one after the other, as a group may have any number of tokens.

Two tokens that end together hold the same last bytes, so the shorter is a suffix of the longer: the
possible pairs of ids follow from the vocabularies alone (some hundred thousand here), whatever the
corpus. Their counts are therefore collected and broadcast. A text is encoded once; its
links are stored as numbers of pairs.

Defined cases: a text that is null or empty, or whose tokens do not spell it (a tokenizer that
normalises), has no tokens; repeated rows are separate texts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.csr import Csr, of_sizes, row_products, token_bytes, transposed
from plumbline.llm.tables import ship, stored

FOLDER = "/opt/tokenizers"
# Texts that a tokenizer gets at a time.
BATCH = 64
UNKNOWN = b"\xff"  # in no text: what holds it does not spell its text
# What byte-level entries are split by before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer texts may hold runs that the expression's stack has no room for.
LONG = 100_000


@dataclass(frozen=True)
class Tokenizers:
    """Files of the two tokenizers, at the same path on every machine."""

    byte_bpe: str = f"{FOLDER}/byte_bpe_50k.json"
    pieces: str = f"{FOLDER}/piece_bpe_32k.model"


def byte_letters() -> dict[str, int]:
    """The letter that byte-level entries write for each byte: itself where it can be seen, else the
    next free code point from 256.
    """
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """A tokenizer with the bytes of its entries."""

    def __init__(self, entries: Sequence[bytes]) -> None:
        self.entries = list(entries)
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        names = [str(i) for i in range(len(self.entries))]
        # Ids with what follows them inside a side, after the first side, and after a group.
        self.names = {c: np.array([n + c for n in names], dtype=object) for c in ",|;"}

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]:
        raise NotImplementedError


class ByteSide(Side):
    """Byte-level BPE over a space and the text.

    Where the ranks of the entries alone give the merges of the file, texts are encoded by ranks: the same
    tokens at a fraction of the time.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        entries = [UNKNOWN] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for entry, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if all(c in letters for c in entry):
                entries[number] = bytes(letters[c] for c in entry)
        super().__init__(entries)
        self.ranked = self._by_ranks(path)

    def _by_ranks(self, path: str):
        """An encoder by ranks; None where it might give other tokens than the file.

        Merging by ranks takes any two neighbours that spell an entry, the file only the pair that it lists. The
        tokens within an entry's span go through the states of the entry alone, and if that ends as the
        entry, it can only come from its listed pair. So both agree if every entry encodes as itself and
        the ids are in the order of the merges.
        """
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not model.get("ignore_merges")
            and not any(file.get(k) for k in ("normalizer", "truncation", "padding"))
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split["add_prefix_space"]
            and all(x["special"] for x in file["added_tokens"])
        )
        if not plain:
            return None
        added = {x["content"] for x in file["added_tokens"]}
        vocab = {entry: i for entry, i in model["vocab"].items() if entry not in added}
        ranks = {self.entries[i]: i for i in vocab.values()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        order = [vocab.get(left + right, -1) for left, right in pairs]
        sound = (
            all(x < y for x, y in zip([-1, *order], order, strict=False))
            and len(ranks) == len(vocab) == len(order) + 256
            and all(bytes([b]) in ranks for b in range(256))
            and all([t.id for t in self.tokenizer.model.tokenize(e)] == [i] for e, i in vocab.items())
        )
        if not sound:
            return None
        import tiktoken

        return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]:
        spaced = [f" {t}" for t in texts]
        if self.ranked is None:
            return self._encode_by_file(spaced)
        found = (
            self.ranked.encode_ordinary(t) if len(t) <= LONG else self._encode_by_file([t])[0] for t in spaced
        )
        return list(found)

    def _encode_by_file(self, spaced: list[str]) -> list[Sequence[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]


class PieceSide(Side):
    """Sentence pieces, which add the space themselves."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        entries = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                entries.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_unknown(i) or model.is_control(i):
                entries.append(UNKNOWN)
            else:
                entries.append(piece.replace("▁", " ").encode())
        super().__init__(entries)

    def encode(self, texts: Sequence[str]) -> list[Sequence[int]]:
        return self.model.encode(list(texts), num_threads=1)


@functools.lru_cache(maxsize=2)
def load(files: Tokenizers) -> tuple[Side, Side]:
    return ByteSide(files.byte_bpe), PieceSide(files.pieces)


@dataclass(frozen=True)
class Alignment:
    """Tokens of both sides, overlap links (a, b, shared bytes) and, of these, the links that end
    together; ``a_groups`` and ``b_groups`` have a row for each group with its tokens.
    """

    a_ids: np.ndarray
    b_ids: np.ndarray
    overlaps: tuple[np.ndarray, np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    a_groups: Csr
    b_groups: Csr

    def shared_groups(self) -> Iterator[tuple[int, np.ndarray]]:
        """(a, all b in its group): the rows of the product of the group incidences."""
        for a, group in enumerate(transposed(self.a_groups).idx.tolist()):
            yield a, self.b_groups.row(group)

    def n_shared_groups(self) -> int:
        """How many entries that product has."""
        return int((np.diff(self.a_groups.ptr) * np.diff(self.b_groups.ptr)).sum())


def align(a: Side, b: Side, a_ids: Sequence[int], b_ids: Sequence[int]) -> Alignment:
    """Both sides must spell the same bytes."""
    a_ids, b_ids = np.asarray(a_ids, dtype=np.int64), np.asarray(b_ids, dtype=np.int64)
    a_sizes, b_sizes = a.sizes[a_ids], b.sizes[b_ids]
    a_bytes, b_bytes = token_bytes(a_sizes), token_bytes(b_sizes)
    overlaps = row_products(a_bytes, transposed(b_bytes))
    left, right, _ = overlaps
    together = a_bytes.ptr[left + 1] == b_bytes.ptr[right + 1]
    left, right = left[together], right[together]
    sides = []
    for last, n in ((left, len(a_ids)), (right, len(b_ids))):
        # Links are in order; a token that ends several of them ends one group.
        cuts = last[np.flatnonzero(np.diff(last, prepend=-1))] + 1
        sides.append(of_sizes(np.diff(cuts, prepend=0), np.arange(n), n))
    return Alignment(a_ids, b_ids, overlaps, (left, right), *sides)


def aligned_texts(
    texts: Sequence[str | None], sides: tuple[Side, Side]
) -> Iterator[Alignment | None]:
    """The alignment of each text; none where a side does not spell a space and the text."""
    a, b = sides
    for at in range(0, len(texts), BATCH):
        part = [t or "" for t in texts[at : at + BATCH]]
        for text, a_ids, b_ids in zip(part, a.encode(part), b.encode(part), strict=True):
            spelled = f" {text}".encode()
            fits = text and all(
                b"".join([side.entries[i] for i in ids]) == spelled
                for side, ids in ((a, a_ids), (b, b_ids))
            )
            yield align(a, b, a_ids, b_ids) if fits else None


def groups_text(x: Alignment, a: Side, b: Side) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    n_a, n_b = np.diff(x.a_groups.ptr), np.diff(x.b_groups.ptr)
    out = np.empty(len(x.a_ids) + len(x.b_ids), dtype=object)
    a_place = np.arange(len(x.a_ids)) + np.repeat(x.b_groups.ptr[:-1], n_a)
    b_place = np.arange(len(x.b_ids)) + np.repeat(x.a_groups.ptr[1:], n_b)
    out[a_place] = a.names[","][x.a_ids]
    out[b_place] = b.names[","][x.b_ids]
    a_last, b_last = x.a_groups.ptr[1:] - 1, x.b_groups.ptr[1:] - 1
    out[a_place[a_last]] = a.names["|"][x.a_ids[a_last]]
    out[b_place[b_last]] = b.names[";"][x.b_ids[b_last]]
    return "".join(out.tolist())[:-1]


ALIGNED = (
    "n_a long, n_b long, n_groups long, n_overlaps long, n_shared_groups long, groups_sha256 string, "
    "pairs binary"
)


def align_documents(docs: DataFrame, files: Tokenizers = Tokenizers()) -> DataFrame:
    """doc_id, the numbers of tokens, groups, overlap links and shared-group links, groups_sha256, and
    ``pairs``: for each link whose tokens end together the number a * |B| + b, as 64-bit or, where the vocabularies
    allow, 32-bit integers.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = sides = load(files)
        kind = pair_type(sides)
        empty = (0, 0, 0, 0, 0, "", b"")
        for batch in batches:
            rows = []
            for x in aligned_texts(batch.tolist(), sides):
                if x is None:
                    rows.append(empty)
                    continue
                left, right = x.ends
                pairs = x.a_ids[left] * len(b.entries) + x.b_ids[right]
                digest = hashlib.sha256(groups_text(x, a, b).encode()).hexdigest()
                numbers = (len(x.a_ids), len(x.b_ids), x.a_groups.rows)
                more = (len(x.overlaps[0]), x.n_shared_groups(), digest)
                rows.append((*numbers, *more, pairs.astype(kind).tobytes()))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ALIGNED.split(", ")])

    aligned = F.pandas_udf(run, ALIGNED)
    return docs.select("doc_id", aligned("text").alias("_x")).select("doc_id", "_x.*")


def pair_type(sides: tuple[Side, Side]) -> str:
    a, b = sides
    return "<u4" if len(a.entries) * len(b.entries) <= 1 << 32 else "<u8"


def pair_counts(aligned: DataFrame, files: Tokenizers = Tokenizers()) -> DataFrame:
    """(pair, n, best): how many links hold each pair of ids, and whether no pair with the same id of B
    has more. A task sends each pair once.
    """
    kind, size = pair_type(load(files)), len(load(files)[1].entries)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = np.array([], dtype=kind), np.array([], dtype=np.int64)
        for frame in frames:
            # Texts are counted a few megabytes at a time, whatever the frame holds.
            held, bytes_held = [], 0
            for data in [*frame["pairs"], None]:
                if data is not None:
                    held.append(np.frombuffer(data, dtype=kind))
                    bytes_held += len(data)
                if held and (data is None or bytes_held > 1 << 23):
                    new, n = np.unique(np.concatenate(held), return_counts=True)
                    both, place = np.unique(np.concatenate([known, new]), return_inverse=True)
                    total = np.zeros(len(both), dtype=np.int64)
                    np.add.at(total, place, np.concatenate([sums, n]))
                    known, sums, held, bytes_held = both, total, [], 0
        yield pd.DataFrame({"pair": known.astype(np.int64), "n": sums})

    parts = aligned.select("pairs").mapInPandas(count, "pair BIGINT, n BIGINT")
    counts = stored(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy(F.pmod("pair", F.lit(size)).alias("_b")).agg(F.max("n").alias("_most"))
    joined = counts.join(most, F.pmod("pair", F.lit(size)) == F.col("_b"))
    return joined.select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def link_counts(docs: DataFrame, files: Tokenizers = Tokenizers()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps,
    n_shared_groups: a row for each row of ``docs`` (doc_id, text).
    """
    spark = docs.sparkSession
    aligned = stored(align_documents(docs, files), "aligned")
    kind = pair_type(load(files))
    counted = pair_counts(aligned, files).orderBy("pair").toArrow()  # bounded by the vocabularies
    table = tuple(counted[c].to_numpy() for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast((table[0].astype(kind), *table[1:]))

    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, counts, best = shared.value
        for batch in batches:
            rows = []
            for data in batch:
                pairs = np.frombuffer(data, dtype=kind)
                at = np.searchsorted(known, pairs)
                rows.append((len(pairs), int(best[at].sum()), int(counts[at].sum())))
            yield pd.DataFrame(rows, columns=["n_links", "n_best", "count_sum"])

    looked_up = F.pandas_udf(look_up, "n_links long, n_best long, count_sum long")
    found = aligned.withColumn("_l", looked_up("pairs"))
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "_l.n_links",
        "_l.n_best",
        "_l.count_sum",
        "groups_sha256",
        "n_overlaps",
        "n_shared_groups",
    )


LINKS = {
    "overlap": "a INT, b INT, a_id INT, b_id INT, bytes INT",
    "ends": "a INT, b INT, a_id INT, b_id INT",
    "group": "group INT, a_ids ARRAY<INT>, b_ids ARRAY<INT>",
}
# Rows of links that leave a task at a time.
LINK_ROWS = 1 << 14


def links(docs: DataFrame, kind: str, files: Tokenizers = Tokenizers()) -> DataFrame:
    """The links of every text as rows with doc_id: tokens by their places ``a`` and ``b`` and their ids.

    ``kind`` is "overlap" (with shared bytes), "ends" (ending together) or "group": a row for each group
    with the ids of both sides, which stands for all its links, as a group may have any number of tokens.
    """
    ship(docs.sparkSession)
    schema = LINKS[kind]
    columns = ["doc", *(c.split(" ")[0] for c in schema.split(", "))]

    def rows(x: Alignment) -> Iterator[tuple]:
        if kind == "group":
            for g in range(x.a_groups.rows):
                yield g, x.a_ids[x.a_groups.row(g)].tolist(), x.b_ids[x.b_groups.row(g)].tolist()
            return
        left, right = x.overlaps[:2] if kind == "overlap" else x.ends
        shared = x.overlaps[2:] if kind == "overlap" else ()
        for at in range(0, len(left), LINK_ROWS):
            part = slice(at, at + LINK_ROWS)
            a, b = left[part], right[part]
            ids = (x.a_ids[a], x.b_ids[b], *(s[part] for s in shared))
            yield from zip(*(values.tolist() for values in (a, b, *ids)), strict=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = load(files)
        for frame in frames:
            for doc, x in zip(frame["doc"], aligned_texts(frame["text"].tolist(), sides), strict=True):
                found = rows(x) if x is not None else iter(())
                while part := [(doc, *r) for r in itertools.islice(found, LINK_ROWS)]:
                    yield pd.DataFrame(part, columns=columns)

    named = docs.select(F.col("doc_id").cast("string").alias("doc"), "text")
    found = named.mapInPandas(run, f"doc STRING, {schema}")
    return found.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *columns[1:])
