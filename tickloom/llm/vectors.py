"""Vectors as blocks of bytes: shared by the top-k search and the near-duplicate scan.

A block is one row: how many vectors it holds and their numbers as plain bytes, so
Spark moves it without looking inside and numpy reads it without a copy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for a vector without null or non-finite components."""
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def lists(col: pa.ListArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def by_length(col: pa.ListArray):
    """(length, row numbers, matrix) of every length in a list column without nulls."""
    size = np.asarray(col.value_lengths())
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield d, at, lists(col.take(pa.array(at)) if len(at) < len(size) else col)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


class Blocks:
    """Gathers vectors of one length after another and gives full blocks back."""

    def __init__(self, size):
        self.size, self.held = size, {}

    def add(self, d: int, *columns: np.ndarray):
        """Full blocks of length d, as tuples of columns."""
        held = self.held.setdefault(d, [])
        held.append(columns)
        most = self.size(d)
        if sum(len(c[0]) for c in held) >= most:
            whole = [np.concatenate(c) for c in zip(*held)]
            n = len(whole[0]) // most * most
            self.held[d] = [tuple(c[n:] for c in whole)]
            for i in range(0, n, most):
                yield tuple(c[i : i + most] for c in whole)

    def rest(self):
        for d, held in self.held.items():
            whole = tuple(np.concatenate(c) for c in zip(*held))
            if len(whole[0]):
                yield d, whole
