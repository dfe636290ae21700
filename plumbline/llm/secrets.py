"""Secrets in text: fixed patterns, and stretches of characters of high entropy.

Candidate strings are maximal runs of characters that keys are made of, holding a letter and a digit. A
window slides over each. Its state carries how often each character is in it, packed into a few numbers: a step
takes one from the character that leaves and adds one to that which enters, and the entropy follows
from these two counts. The limit depends on the class of the run: hexadecimal or wider.

Consecutive windows above the limit are one stretch. What the fixed patterns found is cut out of it, and so
are placeholder words that stand between separators; each part that is left, without separators at its
ends, is a span if it is still a window long, holds a letter and a digit and is not on the allow-list. Runs
that are wholly of an allowed form are not looked into. DataFrame functions only.

Entropies are compared as whole numbers of a millionth of a bit, so results do not depend on the order of sums.

Defined cases: a null text is empty; repeated rows each get their result; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import let

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = 3

# Characters of runs, twelve to a number of the window's state, five bits each.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
PACKED, BITS = 12, 5

# Words that mark what follows or precedes them as a path or a name, and so end a secret.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme")
# What makes a stretch a placeholder: such words inside it, alphabets written out, words and a number.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh"
    r"|^[a-z]+(?:[-_/+=][a-z]+)*[-_/+=]?[0-9]{1,4}$"
)
# Runs of these forms are no secrets as a whole: integrity hashes, words joined by separators.
FORMS = r"(?i)^sha(?:1|256|384|512)-|^[a-z]+(?:[-_/+=][a-z]+)*[-_/+=]?[0-9]{1,4}$"


@dataclass(frozen=True)
class EntropyLimits:
    """Windows of ``window`` characters count with at least so many bits a character."""

    window: int = 20
    hex_bits: float = 2.9
    wide_bits: float = 3.8
    allowed: str = ALLOWED
    forms: str = FORMS

    def __post_init__(self) -> None:
        if not 1 < self.window < 1 << BITS:
            raise ValueError(f"a window has 2 to {(1 << BITS) - 1} characters, not {self.window}")


def scaled(count: int) -> int:
    """count * log2(count) in millionths."""
    return round(count * math.log2(count) * 1e6) if count else 0


def most_sum(bits: float, window: int) -> int:
    """The largest sum of ``scaled`` counts that a window of at least these bits can have."""
    return math.floor(window * (math.log2(window) - bits) * 1e6)


def _hits(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern with their number and the length of the text between them."""
    shape = "array<struct<kind:int,i:int,gap:int,hit:string>>"

    def each(hits: Column) -> Column:
        return let(
            F.split(text, pattern, -1),
            lambda gaps: F.transform(
                hits,
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.length(F.get(gaps, i)).alias("gap"),
                    h.alias("hit"),
                ),
            ),
        )

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), each)
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(shape)


def _stretches(run: Column, limits: EntropyLimits) -> Column:
    """(first, last) of each stretch: starts of its first and its last window above the run's limit."""
    size = limits.window
    table = F.array(*(F.lit(scaled(c)) for c in range(size + 2)))
    is_hex = run.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    most = F.when(is_hex, most_sum(limits.hex_bits, size)).otherwise(
        most_sum(limits.wide_bits, size)
    )
    one = F.lit(1).cast("long")

    def place(char: Column) -> Column:
        """Where a character's count is: the number that holds it, how far up, and one there."""
        return let(
            F.instr(F.lit(ALPHABET), char) - 1,
            lambda code: F.struct(
                F.floor(code / PACKED).cast("int").alias("word"),
                (code % PACKED * BITS).alias("shift"),
                F.call_function("shiftleft", one, code % PACKED * BITS).alias("unit"),
            ),
        )

    def count(held: Column, at: Column) -> Column:
        up = F.call_function("shiftright", F.get(held, at["word"]), at["shift"])
        return up.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def changed(held: Column, at: Column, by: int) -> Column:
        return F.transform(held, lambda h, k: F.when(k == at["word"], h + at["unit"] * by).otherwise(h))

    pair = "struct<first:int,last:int>"
    state = (
        f"struct<total:int,held:array<bigint>,open:int,done:array<{pair}>>"
    )

    def scan(places: Column) -> Column:
        def left(before: Column, i: Column) -> Column:
            """The state without the character that the window leaves behind."""

            def without(at: Column) -> Column:
                return let(
                    count(before["held"], at),
                    lambda n: F.struct(
                        (before["total"] - F.get(table, n) + F.get(table, n - 1)).alias("total"),
                        changed(before["held"], at, -1).alias("held"),
                    ),
                )

            same = F.struct(before["total"].alias("total"), before["held"].alias("held"))
            return F.when(i >= size, let(F.get(places, i - size), without)).otherwise(same)

        def step(before: Column, i: Column) -> Column:
            def entered(now: Column) -> Column:
                def with_it(at: Column) -> Column:
                    return let(
                        count(now["held"], at),
                        lambda m: ended(
                            now["total"] - F.get(table, m) + F.get(table, m + 1),
                            changed(now["held"], at, 1),
                        ),
                    )

                return let(F.get(places, i), with_it)

            def ended(total: Column, held: Column) -> Column:
                dense = (i >= size - 1) & (total <= most)
                start, is_open = i - size + 1, before["open"] >= 0
                closed = F.array(F.struct(before["open"].alias("first"), (start - 1).alias("last")))
                return F.struct(
                    total.alias("total"),
                    held.alias("held"),
                    F.when(dense & is_open, before["open"]).when(dense, start).otherwise(-1).alias("open"),
                    F.when(~dense & is_open, F.concat(before["done"], closed))
                    .otherwise(before["done"])
                    .alias("done"),
                ).cast(state)

            return let(left(before, i), entered)

        words = -(-len(ALPHABET) // PACKED)
        begin = F.struct(
            F.lit(0).alias("total"),
            F.array_repeat(F.lit(0).cast("long"), words).alias("held"),
            F.lit(-1).alias("open"),
            F.array().cast(f"array<{pair}>").alias("done"),
        ).cast(state)
        last = F.size(places) - size

        def close(end: Column) -> Column:
            rest = F.array(F.struct(end["open"].alias("first"), last.alias("last")).cast(pair))
            return F.when(end["open"] >= 0, F.concat(end["done"], rest)).otherwise(end["done"])

        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), begin, step, close)

    return let(F.transform(F.split(run, ""), place), scan)


def _parts(stretch: Column, base: Column, limits: EntropyLimits) -> Column:
    """The spans that are left of a stretch (start, end, text) beside the base spans of its text."""
    crossing = F.filter(base, lambda b: (b["start"] < stretch["end"]) & (stretch["start"] < b["end"]))

    def blank(text: Column, b: Column) -> Column:
        low, high = F.greatest(b["start"], stretch["start"]), F.least(b["end"], stretch["end"])
        return F.overlay(text, F.call_function("repeat", F.lit(" "), high - low), low - stretch["start"] + 1, high - low)

    text = F.aggregate(crossing, stretch["text"], blank)
    for word in PLACEHOLDERS:
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])", " " * len(word))
    part = rf"[A-Za-z0-9][A-Za-z0-9+/_=-]{{{limits.window - 2},}}[A-Za-z0-9+=]"
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    begin = F.struct(stretch["start"].alias("at"), empty.alias("out"))

    def walk(hits: Column, gaps: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            hit, start = F.get(hits, i), state["at"] + F.length(F.get(gaps, i))
            good = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~hit.rlike(limits.allowed)
            end = start + F.length(hit)
            span = F.array(F.struct(start.alias("start"), F.lit(BASE_KINDS).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(good, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

        found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), begin, step, lambda s: s["out"])
        return F.when(F.size(hits) > 0, found).otherwise(empty)

    return let(
        text,
        lambda t: let(
            F.regexp_extract_all(t, F.lit(part), F.lit(0)),
            lambda hits: let(F.split(t, part, -1), lambda gaps: walk(hits, gaps)),
        ),
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.transform(
        spans,
        lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
        ),
    )
    return F.array_join(text, ",")


def find_secrets(docs: DataFrame, limits: EntropyLimits = EntropyLimits()) -> DataFrame:
    """(doc_id, spans): a row for each document with its spans (start, kind, end), sorted; kinds by
    their place in ``KINDS``. Ends are exclusive, both in code points.
    """
    run = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{limits.window},}}"
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = (ASSIGN, ACCESS, HEX, run)
    hits = F.concat(*(_hits(text, p, k) for k, p in enumerate(patterns)))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = numbered.select("doc_id", "row", F.explode_outer(hits).alias("h"))
    rows = rows.select("doc_id", "row", "h.*")
    in_order = Window.partitionBy("row", "kind").orderBy("i")
    size = F.length("hit")
    end = F.sum(F.col("gap") + size).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    value = F.regexp_extract("hit", ASSIGN, 2)
    is_candidate = (
        F.col("hit").rlike("[0-9]")
        & F.col("hit").rlike("[A-Za-z]")
        & ~F.col("hit").rlike(limits.forms)
    )
    kept = (
        F.when(F.col("kind") == 0, F.length(value) >= 8)
        .when(F.col("kind") == BASE_KINDS, is_candidate)
        .otherwise(F.col("kind").isNotNull())
    )
    placed = rows.withColumn("end", end).withColumn("kept", kept)
    dense = F.when(
        F.col("kept") & (F.col("kind") == BASE_KINDS), _stretches(F.col("hit"), limits)
    )
    placed = placed.select(
        "doc_id", "row", "kind", "kept", "end", "hit", size.alias("size"), dense.alias("dense")
    )
    begin = F.col("end") - F.col("size")
    span = F.when(
        F.col("kept") & (F.col("kind") < BASE_KINDS),
        F.struct(begin.alias("start"), F.col("kind"), F.col("end").alias("end")),
    )
    stretches = F.transform(
        "dense",
        lambda d: F.struct(
            (begin + d["first"]).cast("int").alias("start"),
            (begin + d["last"] + limits.window).cast("int").alias("end"),
            F.substring(F.col("hit"), d["first"] + 1, d["last"] - d["first"] + limits.window).alias("text"),
        ),
    )
    shape = "array<struct<start:int,kind:int,end:int>>"
    spans = placed.select(
        "row", "doc_id", span.alias("span"), F.when(F.size("dense") > 0, stretches).alias("stretches")
    )
    grouped = spans.groupBy("row", "doc_id").agg(
        F.collect_list("span").cast(shape).alias("base"), F.flatten(F.collect_list("stretches")).alias("dense")
    )
    added = F.flatten(F.transform("dense", lambda s: _parts(s, F.col("base"), limits)))
    return grouped.select("doc_id", F.sort_array(F.concat("base", added)).alias("spans"))


def secret_counts(docs: DataFrame, limits: EntropyLimits = EntropyLimits()) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans as text."""
    found = find_secrets(docs, limits)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
