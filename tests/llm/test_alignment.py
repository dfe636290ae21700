"""Alignment of tokenizers against a plain version that walks over byte offsets."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import alignment
from plumbline.llm.csr import of_sizes, row_products, token_bytes, transposed

FILES = alignment.Tokenizers()


@pytest.fixture(scope="module")
def sides():
    return alignment.load(FILES)


def dense(m):
    out = np.zeros((m.rows, m.columns), dtype=int)
    for r in range(m.rows):
        np.add.at(out[r], m.row(r), 1)
    return out


def test_row_products_equal_dense_products(monkeypatch):
    rng = np.random.default_rng(3)
    for slice_ in (1 << 20, 3):
        monkeypatch.setattr("plumbline.llm.csr.SLICE", slice_)
        for _ in range(60):
            n, m, k = rng.integers(0, 7, 3)
            matrices = []
            for rows, columns in ((n, m), (m, k)):
                sizes = rng.integers(0, columns + 1, rows)
                idx = [rng.choice(columns, s, replace=False) for s in sizes]
                matrices.append(of_sizes(sizes, np.concatenate([[], *idx]).astype(np.int64), int(columns)))
            a, b = matrices
            out = np.zeros((n, k), dtype=int)
            row, column, value = row_products(a, b)
            out[row, column] = value
            assert (out == dense(a) @ dense(b)).all()
            assert (dense(transposed(a)) == dense(a).T).all()


def test_ranks_give_the_tokens_of_the_file(sides, monkeypatch):
    side, rng = sides[0], random.Random(5)
    assert side.ranked is not None
    odd = ["", " ", "  a", "it's  we'LL\n\n x ", "<|endoftext|>", "\u00a0\u2003a\u0301\u200b", "9²½ ٣"]
    runs = [c * n for c in ("a", " ", "\n", "漢", ".") for n in (999, alignment.LONG - 1, alignment.LONG + 7)]
    letters = [*map(chr, range(0x250)), *"漢字ßあ𝔸🙂 \n\t"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(200)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and rng.random() < 0.02]
    texts += ["".join(f"x{c}1{c}.{c} {c}x\n{c}{c}  {c}" for c in points[at : at + 99]) for at in range(0, len(points), 99)]
    texts += odd + runs
    by_file = [list(x) for x in side._encode_by_file([f" {t}" for t in texts])]
    assert [list(x) for x in side.encode(texts)] == by_file


@pytest.mark.parametrize("what", ["merges", "entry", "split", "normalizer"])
def test_files_whose_ranks_may_differ_are_taken_as_they_are(tmp_path, what):
    with open(FILES.byte_bpe, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if what == "merges":
        model["merges"][:2] = model["merges"][1::-1]
    elif what == "entry":
        model["merges"].pop()  # its entry can no longer be reached
    elif what == "split":
        file["pre_tokenizer"]["use_regex"] = False
    else:
        file["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    side = alignment.ByteSide(str(path))
    assert side.ranked is None
    text = "The Other  way, isn't it"
    assert list(side.encode([text])[0]) == side.tokenizer.encode(f" {text}", add_special_tokens=False).ids


def plain_spans(side, ids):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(side.entries[i]), i))
        at = out[-1][1]
    return out


def plain_alignment(sides, text):
    """None, or (a spans, b spans, overlaps, links, groups text)."""
    ids = [side.encode([text or ""])[0] for side in sides]
    spelled = f" {text}".encode()
    if not text or any(b"".join(s.entries[i] for i in x) != spelled for s, x in zip(sides, ids, strict=True)):
        return None
    a, b = (plain_spans(s, x) for s, x in zip(sides, ids, strict=True))
    overlaps = {
        (i, j): min(x[1], y[1]) - max(x[0], y[0])
        for i, x in enumerate(a)
        for j, y in enumerate(b)
        if min(x[1], y[1]) > max(x[0], y[0])
    }
    links = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] == y[1]]
    cuts = [0, *sorted({x[1] for x in a} & {y[1] for y in b})]
    part = lambda spans, lo, hi: ",".join(str(i) for s, e, i in spans if lo < e <= hi)
    groups = ";".join(
        f"{part(a, lo, hi)}|{part(b, lo, hi)}" for lo, hi in zip(cuts, cuts[1:], strict=False)
    )
    return a, b, overlaps, links, groups


def plain_rows(sides, docs):
    found = [(i, plain_alignment(sides, t)) for i, t in docs]
    count = Counter((x[0][i][2], x[1][j][2]) for _, x in found if x for i, j in x[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for doc_id, x in found:
        if x is None:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, overlaps, links, groups = x
        pairs = [(a[i][2], b[j][2]) for i, j in links]
        rows.append(
            (doc_id, len(a), len(b), groups.count(";") + 1, len(links),
             sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs),
             hashlib.sha256(groups.encode()).hexdigest(), len(overlaps))
        )
    return sorted(rows, key=str)


TEXTS = [
    "Hello world, this is a test of two tokenizers.",
    "Die Überprüfung läuft; être ou ne pas être — ça va?",
    "  two  spaces\n\n\tand tabs \r\n",
    "<|endoftext|> and <s> </s> <unk> <0x41> are plain",
    "日本語のテキスト 🎉🎉 \u0001 mixed",
    "a▁b holds the mark of pieces",
    "\x00 zero",
    "x",
    "\n",
    "1234567890" * 30,
    "ü" * 300,
]


def test_texts_equal_plain_version(sides):
    for text, x in zip(TEXTS, alignment.aligned_texts(TEXTS, sides), strict=True):
        want = plain_alignment(sides, text)
        assert (x is None) == (want is None), text
        if x is None:
            continue
        a, b, overlaps, links, groups = want
        assert [i for _, _, i in a] == x.a_ids.tolist() and [i for _, _, i in b] == x.b_ids.tolist()
        assert {(i, j): v for i, j, v in zip(*(p.tolist() for p in x.overlaps), strict=True)} == overlaps
        assert list(zip(*(p.tolist() for p in x.ends), strict=True)) == links
        assert alignment.groups_text(x, *sides) == groups
        shared = [(i, m.tolist()) for i, m in x.shared_groups()]
        assert [i for i, _ in shared] == list(range(len(a)))
        assert sum(len(m) for _, m in shared) == x.n_shared_groups()


def test_marks_of_pieces_have_no_tokens(sides):
    assert next(alignment.aligned_texts(["a▁b"], sides)) is None


def test_table_equals_plain_version(spark, sides):
    rng = random.Random(11)
    words = "the cat naïve été Straße tokenizer 東京 12.5 <|endoftext|> -- \n".split(" ")
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(60)]
    docs += [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs += [docs[3], docs[3], (None, "no id"), (200, None), (201, ""), (9007199254740993, "large id")]
    rows = [(*d, 5, "c") for d in docs]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_a INT, pairs STRING")
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
    found = alignment.link_counts(table).select(*columns).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_rows(sides, docs)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert alignment.link_counts(empty).collect() == []


def test_link_rows(spark, sides):
    docs = [(1, TEXTS[0]), (None, TEXTS[1]), (2, None)]
    table = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    want = {i: plain_alignment(sides, t) for i, t in docs}
    ends = [tuple(r) for r in alignment.links(table, "ends").collect()]
    assert Counter(ends) == Counter(
        (d, i, j, x[0][i][2], x[1][j][2]) for d, x in want.items() if x for i, j in x[3]
    )
    overlap = [(r.doc_id, r.a, r.b, r.bytes) for r in alignment.links(table, "overlap").collect()]
    assert Counter(overlap) == Counter(
        (d, *k, v) for d, x in want.items() if x for k, v in x[2].items()
    )
    text = lambda r: ",".join(map(str, r.a_ids)) + "|" + ",".join(map(str, r.b_ids))
    groups = alignment.links(table, "group").orderBy("group").collect()
    for d, x in want.items():
        assert ";".join(text(r) for r in groups if r.doc_id == d) == (x[4] if x else "")


def test_pairs_are_suffixes(sides):
    a, b = sides
    x = next(alignment.aligned_texts([TEXTS[1] + TEXTS[4]], sides))
    for i, j in zip(*(p.tolist() for p in x.ends), strict=True):
        left, right = a.entries[x.a_ids[i]], b.entries[x.b_ids[j]]
        assert left.endswith(right) or right.endswith(left)


def test_token_bytes_cover_the_text():
    assert token_bytes(np.array([2, 1, 3])).row(2).tolist() == [3, 4, 5]
