"""Products of two blocks of sparse rows, a piece of the result at a time.

Spark cuts both sides into blocks and brings each two of them together in one group; what is multiplied there
is a few thousand rows by a few thousand. Codes that many rows have go through a dense product, the others
through their matching entries, so a block needs the same memory whatever its codes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Cells of the result, and matching entries, that are held at once.
CELLS = 4_000_000
#: Codes that go through the dense product at most.
DENSE = 512
#: Partitions of a table of blocks at most.
PARTITIONS = 10_000
#: What one matching entry costs in cells of the dense product.
_ENTRY = 64


@dataclass(frozen=True)
class Entries:
    """Entries of ``size`` rows: row, code and weight (None: each counts one)."""

    size: int
    rows: np.ndarray
    codes: np.ndarray
    weights: np.ndarray | None = None

    def only(self, keep: np.ndarray, codes: np.ndarray) -> Entries:
        return Entries(self.size, self.rows[keep], codes[keep], None if self.weights is None else self.weights[keep])

    def by(self, order: np.ndarray) -> Entries:
        return self.only(order, self.codes)

    def dense(self, column: np.ndarray, width: int, kind: type) -> np.ndarray:
        out = np.zeros((self.size, width), dtype=kind)
        has = column[self.codes] >= 0
        np.add.at(out, (self.rows[has], column[self.codes[has]]), 1 if self.weights is None else self.weights[has])
        return out


def products(a: Entries, b: Entries, kind: type = np.float32) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, piece): sums over common codes of the weights' products, some rows of a against all of b."""
    known = np.intersect1d(a.codes, b.codes)
    sides = []
    for side in (a, b):
        at = np.minimum(np.searchsorted(known, side.codes), max(len(known) - 1, 0))
        sides.append(side.only(known[at] == side.codes if len(known) else np.zeros(len(at), bool), at))
    a, b = sides
    in_a, in_b = (np.bincount(s.codes, minlength=len(known)).astype(np.int64) for s in sides)
    work = in_a * in_b
    often = np.flatnonzero(work * _ENTRY > a.size * b.size)
    often = often[np.argsort(-work[often], kind="stable")][:DENSE]
    column = np.full(len(known), -1)
    column[often] = np.arange(len(often))
    a_dense, b_dense = (s.dense(column, len(often), kind) for s in sides)
    a, b = (s.only(column[s.codes] < 0, s.codes) for s in sides)
    a, b = a.by(np.argsort(a.rows, kind="stable")), b.by(np.argsort(b.codes, kind="stable"))
    start = np.searchsorted(b.codes, np.arange(len(known)))
    step = max(1, CELLS // max(b.size, 1))
    for first in range(0, a.size, step):
        last = min(first + step, a.size)
        out = a_dense[first:last] @ b_dense.T
        lo, hi = np.searchsorted(a.rows, [first, last])
        ends = np.cumsum(np.concatenate([[0], in_b[a.codes[lo:hi]]]))
        at = 0
        while at < hi - lo:
            far = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS, "right")) - 1)
            mine = np.arange(lo + at, lo + far)
            many = in_b[a.codes[mine]]
            mine = np.repeat(mine, many)
            met = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + start[a.codes[mine]]
            value = 1 if a.weights is None and b.weights is None else (
                (1 if a.weights is None else a.weights[mine]) * (1 if b.weights is None else b.weights[met]))
            np.add.at(out, (a.rows[mine] - first, b.rows[met]), value)
            at = far
        yield first, out


def numbered(value: str, parts: int = 64) -> Column:
    """A number for each row of a table of distinct values, given within ``parts`` so that no task orders them all."""
    part = F.pmod(F.xxhash64(value), F.lit(parts))
    return F.row_number().over(Window.partitionBy(part).orderBy(value)).cast("long") * parts + part
