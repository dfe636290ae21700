"""Importance resampling against a plain version that splits texts into words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import importance
from plumbline.llm.importance import ResampleSettings, collapsed, ngram_spans, span_pattern

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(small)


def plain_features(text, most):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, settings=ResampleSettings()):
    """(doc_id, n_features, weight, score, rank) of each document, sorted."""

    def buckets(text):
        return [
            zlib.crc32(f.encode()) % settings.buckets for f in plain_features(text, settings.most_words)
        ]

    s = Counter(b for _, text in docs for b in buckets(text))
    t = Counter(b for text in target for b in buckets(text))
    all_s, all_t, n = s.total(), t.total(), settings.buckets
    rows = []
    for doc_id, text in docs:
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n))))
            for b in buckets(text)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        name = "null" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"{settings.seed}:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(gains), weight, score, None, len(plain_words(text))])
    able = [r for r in rows if r[5] >= settings.least_words]
    able.sort(key=lambda r: (-r[3], (r[0] is not None, r[0] or 0)))
    for place, r in enumerate(able[: settings.percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(spark, docs, target, settings=ResampleSettings()):
    docs = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    target = spark.createDataFrame([(t,) for t in target], "text STRING")
    ranks = importance.ranked(importance.scored(docs, target, settings), settings)
    found = ranks.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in found), key=str)


TEXT = "The Quick,brown fox-jumps\x00over été naïve 123 a1b2\n\n\tthe QUICK brown İstanbul ẞ end."


def test_spans_are_the_runs_of_words():
    for most in (1, 2, 3):
        data = collapsed(TEXT)
        found = [data[a:b].decode() for a, b in ngram_spans(data, span_pattern(most))]
        assert sorted(found) == sorted(plain_features(TEXT, most))


@pytest.mark.parametrize("text", ["", " ", "...", "\x00", "x", "x y", "a" * 5000, "é", "\x7f\x80"])
def test_odd_texts(text):
    for most in (1, 2, 4):
        data = collapsed(text)
        found = [data[a:b].decode() for a, b in ngram_spans(data, span_pattern(most))]
        assert sorted(found) == sorted(plain_features(text, most))
        assert importance._words_of(len(found), most) == len(plain_words(text))


def test_equals_plain_version_with_nulls_ties_and_repeats(spark):
    words = "the of maths proof theorem let field cat dog ran far away été où ça".split()
    docs = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(15 + i % 12))) for i in range(120)]
    docs += [(7, docs[7][1]), (7, docs[9][1]), (500, None), (501, ""), (502, " - "), (503, TEXT * 400)]
    docs += [(None, " ".join(words) * 3), (9007199254740993, " ".join(words) * 3)]
    target = ["let the theorem be a proof of the field", "theorem proof", None, ""]
    for settings in (ResampleSettings(), ResampleSettings(3, 97, 5, 60, "x")):
        assert rows_of(spark, docs, target, settings) == plain_resample(docs, [t or "" for t in target], settings)


def test_empty_tables(spark):
    assert rows_of(spark, [], ["a b"]) == []
    docs = [(1, "a b c " * 10), (2, None)]
    assert rows_of(spark, docs, []) == plain_resample(docs, [])


def test_drawn_rows_keep_their_columns_and_equal_rows_are_drawn_in_part(spark):
    settings = ResampleSettings(least_words=2, percent=50)
    rows = [(1, "same words here", 5, "a")] * 5 + [(2, "other words there", 6, "b"), (None, "x y z", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, rank INT, text_hash STRING")
    target = spark.createDataFrame([("other words",)], "text STRING")
    drawn = [tuple(r) for r in importance.resampled(docs, target, settings).collect()]
    want = [r for r in plain_resample([r[:2] for r in rows], ["other words"], settings) if r[4]]
    assert len(drawn) == 3 and sorted(str(r[0]) for r in drawn) == sorted(str(r[0]) for r in want)
    assert set(drawn) <= set(rows)


def test_settings_are_checked():
    for bad in ({"buckets": 0}, {"buckets": 1 << 17}, {"most_words": 0}, {"percent": 101}):
        with pytest.raises(ValueError):
            ResampleSettings(**bad)
