"""Arrow columns as NumPy arrays, for kernels inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as an (n, d) matrix."""
    column = _whole(column)
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def lengths(column) -> np.ndarray:
    """The list lengths of a list column."""
    return np.asarray(_whole(column).value_lengths())


def values(column) -> np.ndarray:
    """A column as a sortable array."""
    array = _whole(column).to_numpy(zero_copy_only=False)
    return array.astype(str) if array.dtype == object else array


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)
