"""Personal data: base spans against plain regular expressions, learning, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, found):
    digits = [c for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute(text):
    spans = [
        (m.start(), list(BASE).index(k), m.end(), k)
        for k, p in BASE.items()
        for m in re.finditer(p, text)
        if passes(k, m[0])
    ]
    return [(s, k, e) for s, _, e, k in sorted(spans)]


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_equal_plain_expressions(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "x", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4539578763621486"]
    parts += ["+1 (212) 555-2368", "+", "5", " ", "-", "é", "😀", "\n", "a@b", "12", "0", "255.255.255.255"]
    text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
    assert pii.base_spans(text)[0] == brute(text)


def test_long_runs_are_scanned_in_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "a@b" + ".c" * 100_000, "+1" + " " * 200_000):
        assert len(pii.base_spans(text)[0]) <= 1


def votes_of(text, kind):
    return [tuple(map(int, c[3].split("|")[1].split(","))) for c in pii.candidates(text)[1] if c[1] == kind]


def test_the_nearest_cue_counts():
    votes = votes_of("Call tel 212-555-2368 or see version 212-555-2368", "telephone")
    assert [v[2] for v in votes] == [1, -1]
    assert [v[2] for v in votes_of("page 7, phone 212-555-2368", "telephone")] == [1]
    assert [v[2] for v in votes_of(f"phone {'x' * 60} 212-555-2368", "telephone")] == [0]


@pytest.mark.parametrize(
    ("text", "found", "cue"),
    [
        ("by Maria Lopez, frau Weber Klein and Then Nothing", ["Maria Lopez", "Weber Klein", "Then Nothing"], [0, 1, 0]),
        ("name: Boris Becker", ["Boris Becker"], [1]),
        ("ask Dr Yolanda Perez today", ["Yolanda Perez"], [1]),
        ("ask Dr. Yolanda Perez", ["Yolanda Perez"], [1]),
        ("It was. Yesterday Boris Becker Won", ["Boris Becker Won"], [0]),
        ("It was. Boris Becker won", ["Boris Becker"], [0]),
        ("Mr Smith", [], []),
    ],
)
def test_all_runs_of_capitals_are_candidates(text, found, cue):
    spans = [(s, e) for s, k, e, *_ in pii.candidates(text)[1] if k == "name"]
    assert [text[s:e] for s, e in spans] == found
    assert [v[2] for v in votes_of(text, "name")] == cue


def test_the_gazetteer_grows_from_the_corpus():
    votes = pii.grown_votes([(3, 10, 2), (4, 11, 2), (5, 10, 1), (6, 20, 0), (7, 19, 0), (8, 1000, 20)])
    assert [int(votes[i]) for i in (3, 4, 5, 6, 7, 8, -1)] == [1, 0, 0, -1, 0, 0, 0]
    assert pii.voted("name|0,0,1,0|1|1", -1) == "name|0,-1,1,0|1|1"


LISTS = {k: getattr(pii, k) for k in ("TITLES", "GIVEN_NAMES", "CUES", "AGAINST", "NOT_NAMES", "BANK_COUNTRIES")}


def plain_names(text):
    """Runs of capitalised words, word by word."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", text)]
    runs = []
    for start, end, word in words:
        if not re.fullmatch("[A-Z][a-zà-ÿ]+", word):
            runs.append([])
        elif runs and runs[-1] and text[runs[-1][-1][1] : start] == " ":
            runs[-1].append((start, end, word))
        else:
            runs.append([(start, end, word)])
    for run in runs:
        if len(run) < 2:
            continue
        rest = list(run)
        while rest and rest[0][2].lower() in LISTS["TITLES"]:
            del rest[0]
        if len(rest) == len(run) > 2 and rest[0][2] not in LISTS["GIVEN_NAMES"]:
            before = text[max(0, rest[0][0] - 40) : rest[0][0]].rstrip().rstrip("\"')]").rstrip()
            if not before or before[-1] in ".!?:;" or "\n" in text[: rest[0][0]][len(text[: rest[0][0]].rstrip()) :]:
                del rest[0]
        if len(rest) > 1:
            yield rest[0][0], rest[-1][1]


def plain_candidates(text):
    matches = [(m.start(), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, text)]
    good = [s for s in matches if passes(s[1], text[s[0] : s[2]])]
    loose = {
        "bank": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
        "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "telephone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    }
    found = [(m.start(), k, m.end()) for k, p in loose.items() for m in re.finditer(p, text)]
    for s in matches:  # of failing base matches those long enough to be looked at
        digits = sum(c in "0123456789" for c in text[s[0] : s[2]])
        if s not in good and (s[1] != "card" or digits >= 14):
            found.append(s)
    found += [(a, "name", b) for a, b in plain_names(text)]
    out = []
    for start, kind, end in sorted(found):
        part, before = text[start:end], re.findall(r"\w+", text[max(0, start - 40) : start].lower())
        digits = [c for c in part if c in "0123456789"]
        form, listed = -1, 0
        if kind == "bank":
            moved = part.replace(" ", "")[4:] + part.replace(" ", "")[:4]
            form = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
            listed = 1 if part[:2] in LISTS["BANK_COUNTRIES"] else -1
        if kind == "identity":
            form = -1 if part[:3] in ("000", "666") or part[0] == "9" or part[4:6] == "00" else 1
        if kind == "telephone":
            form = -1 if digits[0] in "01" or digits[3] in "01" else 1
        if kind == "name":
            form = -1 if any(w in LISTS["NOT_NAMES"] for w in part.split()) else 0
            listed = 1 if part.split()[0] in LISTS["GIVEN_NAMES"] else 0
        says = [1 if w in LISTS["CUES"] else -1 for w in before if w in LISTS["CUES"] or w in LISTS["AGAINST"]]
        cue = 1 if before and before[-1] in LISTS["TITLES"] else says[-1] if says else 0
        near = int(any(start - 100 <= s < end + 100 for s, _, _ in good))
        odd = int(not part.isalnum())
        word = part.split()[0] if kind == "name" and not listed else None
        out.append([start, kind, end, (form, listed, cue, near), min(len(part) // 8, 4), odd, word])
    return good, out


def plain_personal_data(texts):
    """The whole query: spans of each text. Only the training is shared; it has its own test."""
    extracted = [plain_candidates(t or "") for t in texts]
    seen, trusted = Counter(), Counter()
    for _, found in extracted:
        for *_, votes, _, _, word in found:
            if word:
                place = zlib.crc32(word.encode()) % 2**16
                seen[place] += 1
                trusted[place] += votes[2] > 0
    patterns = []
    for _, found in extracted:
        for c in found:
            votes = list(c[3])
            if c[6]:
                place = zlib.crc32(c[6].encode()) % 2**16
                if trusted[place] >= 2 and trusted[place] / seen[place] >= 0.2:
                    votes[1] = 1
                elif seen[place] >= 20 and trusted[place] / seen[place] < 0.02:
                    votes[1] = -1
            c.append(f"{c[1]}|{','.join(map(str, votes))}|{c[4]}|{c[5]}")
            patterns.append(c[-1])
    model = pii.learn(dict(Counter(patterns)))
    result = []
    for good, found in extracted:
        spans = list(good)
        for start, kind, end, *_, pattern in found:
            free = all(e <= start or end < s for s, k, e in good) and all(
                e <= start for s, k, e in spans if (s, k, e) not in good
            )
            if model.probability(pattern) >= 0.5 and free:
                spans.append((start, kind, end))
        order = list(pii.KINDS)
        result.append(",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], order.index(x[1])))))
    return result


def test_whole_query_equals_a_plain_version(documents):
    rng = random.Random(8)
    first = ["Yolanda", "Boris", "Maria", "Igor", "Zed", "Hans", "Monday"]
    pieces = [
        lambda: f"Dr {rng.choice(first)} Perez", lambda: f"name: {rng.choice(first)} Becker", lambda: "In Green Fields",
        lambda: f"met {rng.choice(first)} Novak", lambda: "New Street Corner", lambda: "call 212-555-2368",
        lambda: "version 112-055-2368", lambda: "ssn 123-45-6789", lambda: "order 000-45-6789", lambda: "a@b.co",
        lambda: "iban DE89 3704 0044 0532 0130 00", lambda: "GB00 1234 5678 1234 5678", lambda: "999.1.1.1",
        lambda: "+49 (30) 1234567", lambda: "1234 5678 1234 5678", lambda: ".", lambda: "\n", lambda: "plain words é",
    ]
    texts = [" ".join(rng.choice(pieces)() for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", texts[0]]
    rows = pii.personal_data(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    want = plain_personal_data(texts)
    assert {r["doc_id"]: r["spans"] for r in rows} == dict(enumerate(want))
    kinds = Counter(s.split(":")[0] for w in want for s in w.split(",") if s)
    assert kinds["name"] > 50 and kinds["telephone"] > 20


def test_learning_trusts_the_better_labeler():
    counts = {
        "identity|1,0,1,0|1|1": 400,
        "identity|-1,0,-1,0|1|1": 500,
        "identity|1,0,-1,0|1|1": 20,
        "card|-1,0,0,0|2|0": 300,
        "card|-1,0,1,1|2|0": 30,
    }
    model = pii.learn(counts)
    assert model.probability("identity|1,0,1,0|1|1") > 0.5
    assert model.probability("identity|-1,0,-1,0|1|1") < 0.5
    assert model.probability("card|-1,0,0,0|2|0") < 0.5
    assert pii.learn({}).probability("card|1,1,1,1|2|0") == 0.0


def test_rows_and_odd_cases(spark, documents):
    good = "mail a.b@mail.example.com ip 10.0.0.1"
    docs = documents(
        [
            (1, good, "en", "s"),
            (1, good, "en", "s"),
            (2, None, None, None),
            (None, "", "en", "s"),
            (3, "x " * 50_000 + good, "en", "s"),
        ]
    )
    rows = pii.personal_data(docs.withColumnRenamed("lang", "spans")).collect()
    assert len(rows) == 5
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_email"] for r in by[1]] == [1, 1] and by[1][0]["n_ip"] == 1
    assert by[2][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[2][0]["spans"] == "" and by[None][0]["n_phone"] == 0
    assert by[3][0]["spans"].startswith("email:100005:")
    assert pii.personal_data(docs.where("false")).count() == 0


def test_redaction_replaces_every_base_span(documents):
    docs = documents([(1, "to a@b.co at 1.2.3.4, é a@c.de", "en", "s"), (2, None, "en", "s")])
    rows = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert rows == {1: "to [EMAIL] at [IP], é [EMAIL]", 2: None}
