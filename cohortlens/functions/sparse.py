"""Rows of non-zero values inside a task: what solvers need of them, without a dense copy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Values of a dense array that a task makes at a time.
DENSE = 4_000_000


class SparseRows:
    """``found`` at (``rows``, ``places``) of ``n`` rows with ``width`` columns; ``@`` multiplies by a dense array, ``np.asarray`` gives a dense copy."""

    def __init__(self, n: int, width: int, rows: np.ndarray, places: np.ndarray, found: np.ndarray):
        self.n, self.width, self.rows, self.places, self.found = n, width, rows, places, found

    @staticmethod
    def of(dense: np.ndarray) -> SparseRows:
        rows, places = np.nonzero(dense)
        return SparseRows(*dense.shape, rows, places, dense[rows, places])

    @staticmethod
    def packed(batch: pd.DataFrame, width: int) -> SparseRows:
        """Cells packed one a row (places, found; null for an empty cell)."""
        sizes = [0 if p is None else len(p) for p in batch["places"]]
        held = batch.dropna(subset=["places"])
        places = np.concatenate([np.zeros(0, np.int64), *held["places"]]).astype(np.int64)
        found = np.concatenate([np.zeros(0), *held["found"]]).astype(np.float64)
        return SparseRows(len(batch), width, np.repeat(np.arange(len(batch)), sizes), places, found)

    def __len__(self) -> int:
        return self.n

    def __matmul__(self, m: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.rows, self.found * column[self.places], self.n) for column in m.T]) if m.shape[1] else np.zeros((self.n, 0))

    def transposed(self, m: np.ndarray) -> np.ndarray:
        """The transposed rows times ``m``."""
        return np.column_stack([np.bincount(self.places, self.found * column[self.rows], self.width) for column in m.T])

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.zeros((self.n, self.width))
        out[self.rows, self.places] = self.found
        return out if dtype is None else out.astype(dtype)

    def dense(self, most: int = DENSE) -> Iterator[np.ndarray]:
        """Dense copies of successive rows, of at most ``most`` values each (one row at least); ``rows`` has to be in order."""
        step = max(1, most // max(1, self.width))
        for a in range(0, self.n, step):
            i, j = np.searchsorted(self.rows, (a, a + step))
            yield np.asarray(SparseRows(min(step, self.n - a), self.width, self.rows[i:j] - a, self.places[i:j], self.found[i:j]))

    def totals(self) -> np.ndarray:
        return np.bincount(self.rows, self.found, self.n)

    def squares(self) -> np.ndarray:
        return np.bincount(self.rows, self.found * self.found, self.n)

    def present(self) -> np.ndarray:
        return np.bincount(self.rows[self.found != 0], minlength=self.n)

    def scaled(self, by: np.ndarray) -> SparseRows:
        """Each row divided by its number in ``by``."""
        return SparseRows(self.n, self.width, self.rows, self.places, self.found / by[self.rows])


class DenseRows:
    """A dense array with the products of ``SparseRows``."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __len__(self) -> int:
        return len(self.array)

    def __matmul__(self, m: np.ndarray) -> np.ndarray:
        return self.array @ m

    def transposed(self, m: np.ndarray) -> np.ndarray:
        return self.array.T @ m


def dense_parts(batch: pd.DataFrame, width: int, most: int = DENSE) -> Iterator[pd.DataFrame]:
    """Parts of a batch whose dense arrays of ``width`` columns have at most ``most`` values (one row at least)."""
    step = max(1, most // max(1, width))
    for a in range(0, len(batch), step):
        yield batch.iloc[a : a + step]
