"""Sets of word shingles as sorted 64-bit hashes, computed over arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

# Bytes of text that are hashed at a time; a longer document is hashed by itself.
SLICE = 1 << 20

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sets(texts: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Shingle sets of a slice of texts."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes) + 1  # where the next text begins
    space = _SPACES[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = change[::2], change[1::2]
    if not len(begin):
        return [np.array([], dtype=np.uint64)] * len(texts)
    up, down = _power_tables(len(data))
    sums = np.cumsum(_BYTE[_LOWER[data]] * up, dtype=np.uint64)
    word = mixed((sums[end - 1] - sums[begin - 1]) * down[begin])
    last = np.searchsorted(begin, ends)
    first = np.concatenate([[0], last[:-1]])
    # A shingle's hash depends on the order of its words.
    factors = [np.uint64(pow(_BASE, 7 * k + 3, 2**64)) for k in range(width)]
    out = []
    shingle = None
    if len(word) >= width:
        n = len(word) - width + 1
        shingle = sum((word[k : k + n] * factors[k] for k in range(width)), np.zeros(n, np.uint64))
        shingle = mixed(shingle)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(shingle[a : b - width + 1]))
        elif b > a:
            whole = sum((word[a + k] * factors[k] for k in range(b - a)), np.uint64(b - a))
            out.append(mixed(np.array([whole], dtype=np.uint64)))
        else:
            out.append(np.array([], dtype=np.uint64))
    return out


def shingle_sets(texts: Sequence[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``width`` words.

    Words are split at ASCII white space and A-Z lower-cased. A shorter text is one shingle, a text
    without words has none.
    """
    held: list[bytes] = []
    size = 0
    with np.errstate(over="ignore"):
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            if held and size + len(data) > SLICE:
                yield from _sets(held, width)
                held, size = [], 0
            held.append(data)
            size += len(data) + 1
        if held:
            yield from _sets(held, width)
