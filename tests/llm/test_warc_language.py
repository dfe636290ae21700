"""WARC round trips at every split, and language identification against a plain parser."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language, warc

PAGES = "page_id BIGINT, url STRING, html STRING, payload STRING"


def archive(n=40, seed=1):
    rng = random.Random(seed)
    out, payloads = b"", []
    for i in range(n):
        # Payloads that look like gzip members, and ones that do not compress.
        inner = gzip.compress(rng.randbytes(50)) if i % 3 else rng.randbytes(rng.randint(0, 9000))
        payloads.append(inner)
        out += warc.encode_record(i, f"http://x/{i}", inner, i, False)
    return out, payloads


@pytest.mark.parametrize("step", [1, 97, 1000, 10**7])
def test_ranges_own_the_records_that_start_in_them(step):
    data, payloads = archive(12 if step == 1 else 40)
    found = []
    for start in range(0, len(data), step):
        file = io.BytesIO(data)
        found += list(warc.records_in_range(file, start, min(start + step, len(data))))
    assert [r["page_id"] for r in found] == list(range(len(payloads)))
    assert [r["payload"] for r in found] == payloads


def test_stored_members_inside_a_payload_are_not_records():
    """A payload that holds a whole archive, stored without compression."""
    inner = warc.encode_record(7, "http://inner/", b"inner", 7, False)
    record = warc.encode_record(1, None, inner, 1, False)
    records = list(warc.records_in_range(io.BytesIO(record), 0, len(record)))
    assert [r["page_id"] for r in records] == [1] and records[0]["url"] == ""


def test_small_range_rows_are_read_in_many_tasks(spark, tmp_path):
    """A range is one small row and megabytes to read; adaptive execution must not put all in one task."""
    rows = [(i, f"http://x/{i}", f"page {i} " * 400) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    folder = f"{tmp_path}/warc"
    archives = warc.write_archives(warc.with_first_of_equal(pages), folder)
    read = warc.read_archives(archives, folder, range_bytes=512)
    held = [n for n in read.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(held) == 200 and len(held) >= 8 and max(held) < 100
    assert warc.read_archives(archives.where("false"), folder).count() == 0


def test_headers():
    plain = gzip.decompress(warc.encode_record(5, "http://a b\r\nX: y", b"abc", 2, True))
    head = plain.split(b"\r\n\r\n")[0].decode()
    assert "WARC-Target-URI: http://a%20b%0D%0AX:%20y" in head
    assert "WARC-Refers-To: <urn:page:2>" in head
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert f"WARC-Payload-Digest: sha1:{digest}" in head
    record = warc.decode_record(plain)
    assert record["payload"] is None and record["payload_bytes"] == 3
    assert record["record_type"] == "revisit" and record["refers_to"] == 2


@pytest.mark.parametrize("range_bytes", [500, 1 << 23])
def test_round_trip_of_a_table(spark, range_bytes):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", rng.choice(["a", "b", "é" * 999, "", str(i)]), "clash") for i in range(80)]
    rows += [(80, None, None, None), (None, "http://n", "b", None), rows[0], (81, "u", "long " * 300_000, None)]
    rows += [(2**60 + 1, "u", "alone", None), (None, None, "only null", None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.archive_and_read(pages, range_bytes).collect()
    payload = [(h or "").encode() for _, _, h, _ in rows]
    first = {}
    for (i, *_), p in zip(rows, payload, strict=True):
        if i is not None:
            first[p] = min(first.get(p, i), i)
    want = []
    for (i, *_), p in zip(rows, payload, strict=True):
        f = first.get(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, len(p), digest, *(("response", None) if i == f else ("revisit", f))))
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keep) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"])


def test_round_trip_of_no_pages(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


SMALL = replace(language.LanguageSettings(), sample_documents=20, sample_chars=2000, segment=16)


def plain_phrases(reference, text, segment):
    """Phrases by looking substrings up, segment by segment."""
    count = 0
    for at in range(0, len(text), segment):
        part, start = text[at : at + segment], 0
        count += 1
        for end in range(1, len(part) + 1):
            if part[start:end] not in reference:
                count += 1
                start = end - 1 if part[end - 1] in reference else end
    return count


def test_phrases_equal_a_plain_parser():
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": [draw("abc ", 300)], "y": [draw("bcd ", 300)]}
    model = language.build_model(samples, SMALL)
    squeeze = lambda t: "".join(c for k, c in enumerate(t) if c != " " or k == 0 or t[k - 1] != " ")
    texts = [squeeze(draw("abcd ", rng.randint(1, 100))) for _ in range(60)]
    symbols = [model.codes[language._points(t)] for t in texts]
    got = language.phrase_counts(model, symbols, SMALL.segment)
    for k, name in enumerate(model.languages):
        reference = squeeze(samples[name][0])
        want = [plain_phrases(reference, t, SMALL.segment) for t in texts]
        assert got[:, k].tolist() == want


def labelled(n, seed):
    rng = random.Random(seed)
    words = {
        "en": "the of and to in is that it was for on are with as his they be at".split(),
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
        "fr": "le la les et des en un du une est pour que dans qui par plus pas au sur".split(),
    }
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 40)))
        rows.append((i, text.title() if rng.random() < 0.3 else text, lang, "s"))
    return rows


def test_accuracy_on_documents_that_were_not_learned(documents):
    docs = documents(labelled(400, 4))
    model = language.learn_languages(docs.where("doc_id % 3 <> 1"), SMALL)
    rows = language.identify_languages(docs.where("doc_id % 3 = 1"), model, SMALL)
    truth = {r[0]: r[2] for r in labelled(400, 4)}
    judged = rows.collect()
    right = sum(truth[r["doc_id"]] == r["lang_pred"] for r in judged)
    assert right / len(judged) > 0.97
    assert all(0 <= r["score"] <= 1 for r in judged)


def test_odd_texts(documents):
    model = language.learn_languages(documents(labelled(60, 5)), SMALL)
    odd = [(1, None, "en", "s"), (2, "", None, None), (3, "123 !? \n", "en", "s"), (4, "한국어", None, "s")]
    odd += [(5, "und der die das " * 20_000, "xx", "s"), (5, "der", None, None), (None, "the", "en", "s")]
    rows = language.identify_languages(documents(odd).withColumnRenamed("source", "score"), model).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert by[1] == by[2] == by[3] == ["und"] and by[5] == ["de", "de"]
    assert by[4][0] in model.languages and len(rows) == len(odd)


def test_nothing_to_learn_from_and_nothing_to_judge(documents):
    unlabelled = documents([(1, "text", None, "s"), (2, None, "en", "s"), (None, "x", "en", "s")])
    model = language.learn_languages(unlabelled, SMALL)
    assert model.languages == ()
    assert {r["lang_pred"] for r in language.identify_languages(unlabelled, model).collect()} == {"und"}
    model = language.learn_languages(documents(labelled(9, 6)), SMALL)
    assert language.identify_languages(documents([]), model).count() == 0


def test_language_is_no_input_of_a_prediction(documents):
    docs = documents(labelled(50, 7))
    model = language.learn_languages(docs, SMALL)
    renamed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": -F.col("doc_id")})
    one = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify_languages(docs, model).collect())
    two = sorted((-r["doc_id"], r["lang_pred"]) for r in language.identify_languages(renamed, model).collect())
    assert one == two


def test_letters_and_automaton_sizes():
    model = language.build_model({"en": ["Straße ÉCOLE école"], "none": ["12 34"]}, SMALL)
    assert model.languages == ("en",)
    e, big = model.codes[ord("é")], model.codes[ord("É")]
    assert e == big > 0 and model.codes[ord("7")] == 0
    assert all(t.dtype == np.int32 for t in model.tables)


def test_scripts_of_many_letters_are_told_apart():
    rng = random.Random(8)
    draw = lambda first, n: "".join(chr(first + rng.randrange(400)) for _ in range(n))
    vocabulary = {"ja": 0x4E00, "zh": 0x5E00, "ko": 0xAC00}
    made = {k: [draw(first, 2) for _ in range(300)] for k, first in vocabulary.items()}
    text = lambda k, n: "".join(rng.choice(made[k]) for _ in range(n))
    model = language.build_model({k: [text(k, 2_000)] for k in made} | {"en": ["the of and " * 900]}, SMALL)
    letters = {c for words in made.values() for w in words for c in w}
    assert len({int(model.codes[ord(c)]) for c in letters}) == len(letters) > 500
    truth = [k for k in made for _ in range(20)]
    names, _ = language.predict_texts(model, [text(k, 20) for k in truth], SMALL.segment)
    assert names == truth
    assert sum(k.nbytes + t.nbytes for k, t in zip(model.keys, model.tables, strict=True)) < 4 * 36 * SMALL.sample_chars


def test_one_long_document_gives_a_whole_sample_from_all_of_its_text(documents, monkeypatch):
    samples = {}
    monkeypatch.setattr(language, "build_model", lambda s, _: samples.update(s))
    parts = [c * 30_000 for c in "abcd"]
    rows = [(1, "".join(parts), "one", "s")] + [(9 + i, f"w{i} " * 2_000, "many", "s") for i in range(200)]
    language.learn_languages(documents(rows))
    assert len(samples["one"][0]) >= 64_000 and all(samples["one"][0].count(c) > 5_000 for c in "abcd")
    assert len(samples["many"]) == 128 and all(len(t) <= 503 for t in samples["many"])
