"""Language identification by cross-parsing entropy.

Labelled text of each language is made into a suffix automaton. A text is parsed from left to right into the
longest phrases that occur in the language's labelled text; fewer phrases mean lower cross entropy.
The phrase count, times the log of the labelled text's length, is compared over the languages, and the least
wins.

The automaton follows single characters, so all segments of a batch of texts step through it side by
side as arrays. Texts are parsed whole, in segments of ``segment`` characters; no phrase crosses
a segment's end.

The labelled text is a bounded sample: for each language, the first ``sample_documents`` documents in
the order of a hash of doc_id give up to ``sample_chars`` characters. Each gives twice its even share of them, in
``slices`` spread over its text; a text within that share is taken whole. Everything is compared with that.

Every letter of the samples is a symbol. An automaton of n characters has at most 3n transitions, so a
language takes no more than about 1.2 MB, broadcast, however many letters it has.

Defined cases: a text that is null or without a letter is ``und`` with score 0, as is every text if nothing is
labelled; equal counts go to the language first by name; repeated rows each get their result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import ship

UNKNOWN = "und"
CODE_POINTS = 0x110000


@dataclass(frozen=True)
class LanguageSettings:
    sample_documents: int = 128
    sample_chars: int = 32_000
    segment: int = 512
    slices: int = 4


@dataclass(frozen=True)
class LanguageModel:
    """``codes``: code point to symbol, 0 for all but letters. ``keys[l]``: state * symbols + symbol of each transition,
    in order; ``tables[l]``: the state it leads to. ``roots[l][symbol]``: the state after a phrase that begins with the
    symbol. ``bits[l]``: log2 of the labelled text's length.
    """

    languages: tuple[str, ...]
    codes: np.ndarray
    letters: np.ndarray
    symbols: int
    keys: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    roots: tuple[np.ndarray, ...]
    bits: tuple[float, ...]


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case form."""
    points = [chr(c) for c in range(CODE_POINTS)]
    letters = np.fromiter((c.isalpha() for c in points), dtype=bool, count=CODE_POINTS)
    lower = np.arange(CODE_POINTS, dtype=np.uint32)
    for c in np.flatnonzero(letters):
        small = points[c].lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return letters, lower


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _suffix_automaton(symbols: Sequence[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the automaton of all substrings: state * size + symbol, in order, and next states."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        current = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in nexts[p]:
            nexts[p][s] = current
            p = link[p]
        if p >= 0:
            q = nexts[p][s]
            if length[p] + 1 == length[q]:
                link[current] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(s) == q:
                    nexts[p][s] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    keys = np.array([k * size + s for k, out in enumerate(nexts) for s in out], dtype=np.int64)
    targets = np.array([t for out in nexts for t in out.values()], dtype=np.int32)
    order = np.argsort(keys)
    return keys[order], targets[order]


def build_model(samples: dict[str, list[str]], settings: LanguageSettings) -> LanguageModel:
    """Automata of the languages' sample texts, cut to one length for all that have it."""
    letters, lower = _letters()
    flat: dict[str, np.ndarray] = {}
    for language, texts in samples.items():
        points = _points(" ".join(texts))
        flat[language] = np.where(letters[points], lower[points], 32)
    joined = np.concatenate([*flat.values(), np.array([], dtype=np.uint32)])
    used = np.unique(joined[joined != 32])
    # Symbol 0 is all that is no letter, the last symbol all letters that the samples lack.
    size = len(used) + 2
    plain = np.zeros(CODE_POINTS, dtype=np.int32)
    plain[letters] = size - 1
    plain[used] = np.arange(1, len(used) + 1)
    codes = plain[lower]
    languages, keys, tables, roots, bits = [], [], [], [], []
    for language in sorted(flat):
        symbols = _squeezed(codes[flat[language]])[: settings.sample_chars]
        if not (symbols > 0).any():
            continue
        places, targets = _suffix_automaton(symbols.tolist(), size)
        root = np.zeros(size, dtype=np.int32)
        from_root = places < size
        root[places[from_root]] = targets[from_root]
        languages.append(language)
        keys.append(places)
        tables.append(targets)
        roots.append(root)
        bits.append(float(np.log2(len(symbols) + 1)))
    return LanguageModel(
        tuple(languages), codes, letters, size, tuple(keys), tuple(tables), tuple(roots), tuple(bits)
    )


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """One 0 for each run of them."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    return symbols[keep]


def phrase_counts(model: LanguageModel, texts: Sequence[np.ndarray], segment: int) -> np.ndarray:
    """Phrases of each text (as symbols) by language: an array (texts, languages)."""
    out = np.zeros((len(texts), len(model.languages)))
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return out
    whole = np.concatenate(texts)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pieces = -(-lengths // segment)
    owner = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begins[owner] + number * segment
    size = np.minimum(lengths[owner] - number * segment, segment)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    for at, (keys, table, root) in enumerate(zip(model.keys, model.tables, model.roots, strict=True)):
        state = np.zeros(len(start), dtype=np.int64)
        phrases = np.ones(len(start), dtype=np.int64)
        for i in range(int(size[0])):
            active = int(np.searchsorted(-size, -i, side="left"))
            symbol = whole[start[:active] + i]
            wanted = state[:active] * model.symbols + symbol
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            goes_on = keys[place] == wanted
            phrases[:active] += ~goes_on
            state[:active] = np.where(goes_on, table[place], root[symbol])
        out[:, at] = np.bincount(owner, weights=phrases, minlength=len(texts))
    return out


def predict_texts(
    model: LanguageModel, texts: Sequence[str | None], segment: int
) -> tuple[list[str], list[float]]:
    """A language and a score (how much dearer the second is) for each text."""
    points = [_points(t or "") for t in texts]
    known = np.array([len(p) > 0 and bool(model.letters[p].any()) for p in points], dtype=bool)
    names, scores = [UNKNOWN] * len(points), [0.0] * len(points)
    if not model.languages or not known.any():
        return names, scores
    chosen = np.flatnonzero(known)
    symbols = [_squeezed(model.codes[points[i]]) for i in chosen]
    costs = phrase_counts(model, symbols, segment) * np.array(model.bits)
    best = costs.argmin(axis=1)
    for row, i in enumerate(chosen):
        ordered = np.sort(costs[row])
        names[i] = model.languages[best[row]]
        scores[i] = 1.0 if len(ordered) < 2 else float(1 - ordered[0] / ordered[1])
    return names, scores


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _spread(text: Column, share: Column, slices: int) -> Column:
    """The text if it has at most ``share`` characters, else as many in slices from its start to its end."""
    size = F.floor(share / slices).cast("int")
    room = F.length(text) - size
    starts = [F.floor(room * k / max(1, slices - 1)).cast("int") + 1 for k in range(slices)]
    parts = F.concat_ws(" ", *(F.substring(text, start, size) for start in starts))
    return F.when(F.length(text) <= share, text).otherwise(parts)


def learn_languages(
    docs: DataFrame, settings: LanguageSettings = LanguageSettings()
) -> LanguageModel:
    """The model of the labelled rows of ``docs``. Only ids and hashes are ordered, the texts of the
    chosen documents are fetched by id; both are bounded by the settings and the languages.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    labelled = labelled.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    chosen = (
        labelled.select("lang", "doc_id", F.row_number().over(order).alias("n"))
        .where(F.col("n") <= settings.sample_documents)
        .select("lang", "doc_id")
        .collect()
    )
    ids = sorted({r["doc_id"] for r in chosen})
    if not ids:
        return build_model({}, settings)
    # A document gives twice its even share, so that short ones do not leave the sample short.
    given = Counter(lang for lang, _ in {(r["lang"], r["doc_id"]) for r in chosen})
    shares = [F.lit(x) for lang, n in given.items() for x in (lang, 2 * settings.sample_chars // n)]
    share = F.element_at(F.create_map(*shares), F.col("lang"))
    rows = (
        labelled.where(F.col("doc_id").isin(ids))
        .groupBy("lang", "doc_id")
        .agg(F.min(_spread(F.col("text"), share, settings.slices)).alias("text"))
        .orderBy("lang", F.xxhash64("doc_id"), "doc_id")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r["lang"], []).append(r["text"])
    return build_model(samples, settings)


def identify_languages(
    docs: DataFrame, model: LanguageModel, settings: LanguageSettings = LanguageSettings()
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for each row of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slice_chars = 1 << 21

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if t is None else t for t in batch]
            names: list[str] = []
            scores: list[float] = []
            at = 0
            while at < len(texts):  # arrays over a few million characters at a time
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= slice_chars):
                    held += len(texts[end] or "")
                    end += 1
                n, s = predict_texts(shared.value, texts[at:end], settings.segment)
                names += n
                scores += s
                at = end
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    judge = F.pandas_udf(predict, "lang_pred string, score double")
    judged = docs.select("doc_id", judge("text").alias("x"))
    return judged.select("doc_id", "x.lang_pred", "x.score")
