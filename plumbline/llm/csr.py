"""Sparse 0/1 matrices in compressed rows, built by hand from arrays, and their row products."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Entries of a product that are worked on at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class Csr:
    """Row r has ones in the columns ``idx[ptr[r] : ptr[r + 1]]``."""

    ptr: np.ndarray
    idx: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.ptr) - 1

    def row(self, r: int) -> np.ndarray:
        return self.idx[self.ptr[r] : self.ptr[r + 1]]


def of_sizes(sizes: np.ndarray, idx: np.ndarray, columns: int) -> Csr:
    ptr = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=ptr[1:])
    return Csr(ptr, idx, columns)


def token_bytes(sizes: np.ndarray) -> Csr:
    """Tokens by the bytes they cover, where tokens of ``sizes`` follow each other."""
    total = int(sizes.sum())
    return of_sizes(sizes, np.arange(total, dtype=_index_type(total)), total)


def _index_type(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(m.rows, dtype=_index_type(m.rows)), np.diff(m.ptr))
    if (m.idx[1:] < m.idx[:-1]).any():
        rows = rows[np.argsort(m.idx, kind="stable")]
    return of_sizes(np.bincount(m.idx, minlength=m.columns), rows, m.rows)


def row_products(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of A·B, by Gustavson: a row of the product is the sum of
    those rows of B that the row of A names. Rows are done in slices of bounded work.
    """
    width = np.diff(b.ptr)
    take = width[a.idx]
    ends = a.ptr if (take == 1).all() else np.concatenate([[0], np.cumsum(take)])[a.ptr]
    out = []
    at = 0
    while at < a.rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
        out.append(_products(a, b, take, at, to))
        at = to
    if not out:
        none = np.array([], dtype=np.int64)
        return none, none, none
    return out[0] if len(out) == 1 else tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _products(
    a: Csr, b: Csr, take: np.ndarray, at: int, to: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of the rows from ``at`` to ``to``; ``take`` is how many summands each one of A has."""
    named, take = a.idx[a.ptr[at] : a.ptr[to]], take[a.ptr[at] : a.ptr[to]]
    row = np.repeat(np.arange(at, to, dtype=_index_type(to)), np.diff(a.ptr[at : to + 1]))
    place = b.ptr[named]
    if (take != 1).any():
        row = np.repeat(row, take)
        # The place in B of each summand: where its row begins, and how far in it is.
        place = np.repeat(place - (np.cumsum(take) - take), take) + np.arange(len(row))
    column = b.idx[place]
    if not len(row):
        return row, column, row
    same = row[1:] == row[:-1]
    if (same & (column[1:] < column[:-1])).any():
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = ~same | (column[1:] != column[:-1])
    first = np.flatnonzero(new)
    return row[first], column[first], np.diff(first, append=len(row))
