"""Personal data by weak supervision.

Fixed patterns give the base spans, which always stay. Candidates are looser matches: base matches that fail their check,
national telephone and identity numbers, bank accounts, and as names all runs of capitalised words. For each, labelers vote for or
against or not at all: a strict form, gazetteers, the nearest cue before it and personal data near it.
Expectation-maximisation estimates how reliable each labeler is and how likely each pattern of votes; a
logistic classifier is trained on these likelihoods over all candidates of the corpus, and candidates
that it accepts are added where they overlap nothing found before.

The gazetteer of given names grows from the corpus: of the names that begin with a word, how many stand behind
a title or a cue such as "name:". These counts are kept by a hash of the word, in a table of fixed size.

Candidates are reduced to patterns (kind, votes, two features of form), of which there are at most a few
thousand whatever the corpus; only counts of patterns and of the table's entries reach the driver.

Defined cases: a null text is empty; repeated rows each get their result; an empty table, or one without
candidates, adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import ship, stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "bank", "identity", "name", "telephone")
LABELERS = ("form", "gazetteer", "words_before", "near")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# A digit before it would belong to the same leftmost match.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_TELEPHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IDENTITY = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_BANK = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])")
_CAPITALS = re.compile(r"(?<!\w)[A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)+(?!\w)")
_SENTENCE_ENDS = re.compile(r"(?:^|[.!?:;\n])[\"')\]]*\s*$")

TITLES = frozenset("mr mrs ms dr prof herr frau señor señora monsieur madame mme".split())
GIVEN_NAMES = frozenset(
    "Anna Anne Antonio Carlos Carmen Charles Claire David Elena Emma Francisco Hans Helga Isabel "
    "James Jean John Jose Juan Julia Karl Klaus Laura Linda Louis Lucia Luis Marie Maria Mary "
    "Michael Miguel Paul Pedro Peter Pierre Robert Sarah Sofia Sophie Susan Thomas Wolfgang".split()
)
# Capitalised words that are no part of a person's name.
NOT_NAMES = frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July "
    "August September October November December Street Road Avenue University Company Inc Ltd City Park".split()
)
BANK_COUNTRIES = frozenset("AT BE CH DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split())
CUES = frozenset(
    "account address birth call card contact credit customer email fax iban id identity insurance "
    "konto mail mobile name numéro número passport patient phone social ssn tel telefon telephone "
    "teléfono téléphone whatsapp".split()
)
AGAINST = frozenset(
    "build chapter figure invoice isbn issue order page part product release section serial table "
    "ticket version".split()
)
_WORD = re.compile(r"\w+")
BEFORE = 40
NEAR = 100
# Places of the gazetteer that grows from the corpus.
NAME_BUCKETS = 1 << 16


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(start, kind, end) of what passes, and of what fails its check. Linear in the text."""
    good: list[tuple[int, str, int]] = []
    failed: list[tuple[int, str, int]] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                done = domain.end()
                good.append((start, "email", done))
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return good, failed
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        fits = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        (good if fits else failed).append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = [ord(c) - 48 for c in m[0] if c not in " -"]
        fits = len(digits) <= 19 and _luhn(digits)
        (good if fits else failed).append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            fits = 10 <= sum(c.isdigit() for c in m[0]) <= 15
            (good if fits else failed).append((m.start(), "phone", m.end()))
    good.sort(key=lambda s: (s[0], BASE_KINDS.index(s[1])))
    return good, failed


def _luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[::-2])) % 10 == 0


def _form(kind: str, found: str) -> int:
    digits = [c for c in found if c.isdigit()]
    if kind == "bank":
        plain = found.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "identity":
        return -1 if found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" else 1
    if kind == "telephone":
        return -1 if digits[0] in "01" or digits[3] in "01" else 1
    if kind == "name":
        return -1 if NOT_NAMES.intersection(found.split(" ")) else 0
    return -1


def _gazetteer(kind: str, found: str) -> int:
    if kind == "bank":
        return 1 if found[:2] in BANK_COUNTRIES else -1
    return 1 if kind == "name" and found.split(" ")[0] in GIVEN_NAMES else 0


def _cue(before: list[str]) -> int:
    """What the nearest cue says; a title counts where it is the last word."""
    if before and before[-1] in TITLES:
        return 1
    for word in reversed(before):
        if word in CUES:
            return 1
        if word in AGAINST:
            return -1
    return 0


def names(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of two capitalised words or more, without titles before them, and without a
    first word that may have its capital from the sentence it begins, if two words are left.
    """
    for m in _CAPITALS.finditer(text):
        words, start = m[0].split(" "), m.start()
        titled = False
        while words and words[0].lower() in TITLES:
            start += len(words.pop(0)) + 1
            titled = True
        begins = not titled and len(words) > 2 and words[0] not in GIVEN_NAMES
        if begins and _SENTENCE_ENDS.search(text[max(0, start - BEFORE) : start]):
            start += len(words.pop(0)) + 1
        if len(words) > 1:
            yield start, m.end()


def name_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % NAME_BUCKETS


def candidates(text: str) -> tuple[list[tuple[int, str, int]], list[tuple]]:
    """Base spans, and candidates (start, kind, end, pattern, bucket, trusted): of a name that no list
    has, ``bucket`` is the place of its first word in the grown gazetteer (-1 otherwise), and ``trusted``
    says that a title or a cue comes before it.
    """
    good, failed = base_spans(text)
    found = list(failed)
    if _DIGIT.search(text):
        for kind, pattern in (("bank", _BANK), ("identity", _IDENTITY), ("telephone", _TELEPHONE)):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    out = []
    good_starts = [s for s, _, _ in good]
    for start, kind, end in sorted([*found, *((a, "name", b) for a, b in names(text))]):
        before = [w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])]
        part = text[start:end]
        cue = _cue(before)
        at = int(np.searchsorted(good_starts, start - NEAR))
        near = 1 if at < len(good) and good_starts[at] < end + NEAR else 0
        listed = _gazetteer(kind, part)
        votes = (_form(kind, part), listed, cue, near)
        separators = int(any(not c.isalnum() for c in part))
        pattern = f"{kind}|{','.join(map(str, votes))}|{min(len(part) // 8, 4)}|{separators}"
        bucket = name_bucket(part.split(" ")[0]) if kind == "name" and not listed else -1
        out.append((start, kind, end, pattern, bucket, cue > 0))
    return good, out


def grown_votes(counts: Iterable[tuple[int, int, int]]) -> np.ndarray:
    """The vote of each place of the table, from (bucket, names, trusted names)."""
    votes = np.zeros(NAME_BUCKETS + 1, dtype=np.int8)  # the last is for candidates without a bucket
    for bucket, n, trusted in counts:
        if trusted >= 2 and 5 * trusted >= n:
            votes[bucket] = 1
        elif n >= 20 and 50 * trusted < n:
            votes[bucket] = -1
    return votes


def voted(pattern: str, vote: int) -> str:
    """The pattern of a candidate with the vote of the grown gazetteer, if that has one."""
    if not vote:
        return pattern
    kind, votes, rest = pattern.split("|", 2)
    form, _, others = votes.split(",", 2)
    return f"{kind}|{form},{vote},{others}|{rest}"


@dataclass(frozen=True)
class SpanClassifier:
    """Weights of the trained classifier; ``probability`` of a pattern. Empty: nothing is accepted.
    ``names`` has the votes of the grown gazetteer.
    """

    weights: dict[str, float]
    reliability: dict[str, tuple[float, float]]
    names: np.ndarray | None = None

    def probability(self, pattern: str) -> float:
        if not self.weights:
            return 0.0
        z = sum(self.weights.get(f, 0.0) for f in features(pattern))
        return float(1 / (1 + np.exp(-z)))


def features(pattern: str) -> list[str]:
    kind, votes, length, separators = pattern.split("|")
    named = [f"{n}={v}" for n, v in zip(LABELERS, votes.split(","), strict=True) if v != "0"]
    return ["all", f"kind={kind}", *named, f"length={length}", f"separators={separators}"]


def _estimated(
    n: np.ndarray, votes: np.ndarray, likely: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """How likely each pattern of votes is personal data, and by class and labeler the rates of votes
    against, none and for.
    """
    rates = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        share = (n @ likely + 1) / (n.sum() + 4)
        odds = np.full(len(n), np.log(share / (1 - share)))
        for j in range(len(LABELERS)):
            for y, weight in enumerate((n * (1 - likely), n * likely)):
                seen = np.array([weight[votes[:, j] == v].sum() for v in (-1, 0, 1)])
                # Prior: a labeler is right more often than not.
                seen += (1.0, 1.0, 3.0) if y else (3.0, 1.0, 1.0)
                rates[y, j] = seen / seen.sum()
            odds += np.log(rates[1, j, votes[:, j] + 1] / rates[0, j, votes[:, j] + 1])
        likely = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return likely, rates


def learn(counts: dict[str, int], rounds: int = 60) -> SpanClassifier:
    """Expectation-maximisation over the counted patterns, then logistic regression on its result.

    How often a labeler votes for, not at all, or against is estimated for each kind by itself, as most
    labelers know some kinds only: whether they vote would else tell the kinds apart.
    """
    if not counts:
        return SpanClassifier({}, {})
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    kinds = np.array([p.split("|")[0] for p in patterns])
    votes = np.array([[int(v) for v in p.split("|")[1].split(",")] for p in patterns])
    # Begin with the majority of the votes.
    likely = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float) + 0.5))
    trust = {}
    for kind in sorted(set(kinds)):
        own = kinds == kind
        likely[own], rates = _estimated(n[own], votes[own], likely[own], rounds)
        trust |= {
            f"{kind} {name}": (float(rates[1, j, 2]), float(rates[0, j, 0])) for j, name in enumerate(LABELERS)
        }
    names = sorted({f for p in patterns for f in features(p)})
    column = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for row, p in enumerate(patterns):
        x[row, [column[f] for f in features(p)]] = 1
    w = np.zeros(len(names))
    scale = n / n.sum() * min(n.sum(), 1e4)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (likely - p)) - w
        hessian = (x * (scale * p * (1 - p))[:, None]).T @ x + np.eye(len(names))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return SpanClassifier({f: round(float(w[i]), 9) for f, i in column.items()}, trust)


def _accepted(
    good: list[tuple[int, str, int]],
    found: list[tuple],
    probability: dict[str, float],
    names: np.ndarray | None,
) -> list[tuple[int, str, int]]:
    """Base spans and accepted candidates that overlap nothing accepted before; in order."""
    added: list[tuple[int, str, int]] = []
    vote = (lambda bucket: 0) if names is None else (lambda bucket: int(names[bucket]))
    likely = [probability.get(voted(f[3], vote(f[4])), 0.0) >= 0.5 for f in found]
    if not any(likely):
        return good
    starts = np.array([s for s, _, _ in good], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, e in good], dtype=np.int64))
    last = -1
    for (start, kind, end, *_), accepted in zip(found, likely, strict=True):
        at = int(np.searchsorted(starts, end))
        if accepted and start >= last and not (at and reach[at - 1] > start):
            added.append((start, kind, end))
            last = end
    return sorted([*good, *added], key=lambda s: (s[0], KINDS.index(s[1])))


SPAN = "struct<start:int,kind:string,end:int>"
CANDIDATE = ("start", "kind", "end", "pattern", "bucket", "trusted")
FOUND = (
    f"struct<good:array<{SPAN}>,found:array<struct<start:int,kind:string,end:int,pattern:string,"
    "bucket:int,trusted:boolean>>>"
)


def _extract(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = [candidates(t or "") for t in batch]
        span = lambda s: dict(zip(CANDIDATE, s, strict=False))
        yield pd.DataFrame(
            {"good": [[span(s) for s in g] for g, _ in rows], "found": [[span(s) for s in f] for _, f in rows]}
        )


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``: the base spans and the candidates of each text."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(_extract, FOUND)("text").alias("x"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans, for each row of ``docs``.
    The text is read once: what is found in it is stored, and the trained classifier runs over that.
    """
    found = stored(extracted(docs), "spans")
    digest = digest_columns(learn_from(found))
    return found.select("doc_id", digest("x").alias("d")).select("doc_id", "d.*")


def learn_from(found: DataFrame) -> SpanClassifier:
    """The classifier of all candidates in column ``x``, with the gazetteer that they grow."""
    each = found.select(F.explode("x.found").alias("f")).where("f.bucket >= 0")
    table = each.groupBy("f.bucket").agg(F.count("*").alias("n"), F.count_if("f.trusted").alias("trusted"))
    votes = grown_votes((r["bucket"], r["n"], r["trusted"]) for r in table.collect())  # NAME_BUCKETS rows

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for frame in frames:
            for one in frame["found"]:
                total.update(voted(f["pattern"], int(votes[f["bucket"]])) for f in one)
        if total:
            yield pd.DataFrame({"pattern": list(total), "n": list(total.values())})

    counted = found.select("x.found").mapInPandas(count, "pattern STRING, n BIGINT").groupBy("pattern")
    rows = counted.agg(F.sum("n").alias("n")).collect()  # a row for each pattern
    return replace(learn({r["pattern"]: r["n"] for r in rows}), names=votes)


def _probabilities(model: SpanClassifier) -> dict[str, float]:
    """Of every pattern that can occur."""
    votes = [
        f"{a},{b},{c},{d}" for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for d in (0, 1)
    ]
    every = (f"{k}|{v}|{n}|{s}" for k in KINDS for v in votes for n in range(5) for s in (0, 1))
    return {p: q for p in every if (q := model.probability(p)) >= 0.5}


def digest_columns(model: SpanClassifier):
    """A function of the extracted column: counts of base kinds, their hash, all spans."""
    likely = _probabilities(model)
    names = [f"n_{k}" for k in BASE_KINDS]
    schema = ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string"

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        for frame in parts:
            rows = []
            for g, f in zip(frame["good"], frame["found"], strict=True):
                good = [(s["start"], s["kind"], s["end"]) for s in g]
                found = [tuple(s[c] for c in CANDIDATE) for s in f]
                kinds = [k for _, k, _ in good]
                rows.append(
                    (
                        *(kinds.count(k) for k in BASE_KINDS),
                        hashlib.sha256(text(good).encode()).hexdigest(),
                        text(_accepted(good, found, likely, model.names)),
                    )
                )
            yield pd.DataFrame(rows, columns=[*names, "base_sha256", "spans"])

    return F.pandas_udf(digest, schema)


def redacted_text(model: SpanClassifier):
    """A function of text that puts the kind in brackets in place of each span."""
    likely = _probabilities(model)

    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = [None if t is None else redact_one(t, likely, model.names) for t in batch]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(redact, "string")


def redact_one(text: str, probability: dict[str, float], names: np.ndarray | None = None) -> str:
    out, at = [], 0
    for start, kind, end in _accepted(*candidates(text), probability, names):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:  # overlaps the one before: its rest goes with it
            at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, by a classifier trained on all of it."""
    model = learn_from(stored(extracted(docs), "spans"))
    return docs.withColumn("text", redacted_text(model)("text"))
