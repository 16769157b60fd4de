"""Arrow lists to numpy matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(lists: pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a float64 matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    rows = len(lists)
    if lists.null_count:
        raise ValueError("null vector in input")
    values = lists.flatten()
    if values.null_count:
        raise ValueError("null value inside a vector")
    flat = values.to_numpy(zero_copy_only=False)
    width = flat.size // rows if rows else 0
    lengths = np.diff(lists.offsets.to_numpy())
    if rows and (lengths != width).any():
        raise ValueError("vectors of different lengths in one batch")
    return flat.astype(np.float64, copy=False).reshape(rows, width)


def to_lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow array of lists."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def vector_rows(vectors: list[np.ndarray]) -> pa.Array:
    """Vectors of any lengths as an Arrow array of lists."""
    offsets = np.concatenate([[0], np.cumsum([v.size for v in vectors])]).astype(np.int64)
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"{offsets[-1]} values do not fit one batch of lists")
    offsets = offsets.astype(np.int32)
    flat = np.concatenate(vectors) if vectors else np.empty(0)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def elementwise(function, *lists: pa.Array) -> pa.Array:
    """Apply a numpy function to the values of equally shaped lists."""
    first = lists[0]
    offsets = first.offsets.to_numpy() - (first.offsets[0].as_py() if len(first.offsets) else 0)
    values = []
    for each in lists:
        flat = each.flatten()
        if each.null_count or flat.null_count or len(flat) != offsets[-1]:
            raise ValueError("vectors of different lengths or with nulls")
        values.append(flat.to_numpy(zero_copy_only=False))
    with np.errstate(all="ignore"):
        return pa.ListArray.from_arrays(offsets, pa.array(function(*values)))
