"""What the vector operators share: valid vectors in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and a matrix of the rows that are vectors: not null, all components finite, not all zero, of the given width."""
    column = column.cast(pa.list_(pa.float64()))
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
    size = np.array(column.value_lengths().fill_null(0))
    bound = np.concatenate(([0], np.cumsum(size)))
    if width is None:
        width = int(size.max()) if len(size) else 0
    rows = np.flatnonzero((size == width) & (width > 0))
    x = flat[bound[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    good = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    return rows[good], x[good]


def width_of(vectors: DataFrame, column: str) -> int:
    """The commonest width of the vectors, the smaller one of equally common ones; 0 for a table without vectors."""
    sizes = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).groupBy(F.size(column).alias("width")).count()
    first = sizes.orderBy(F.desc("count"), "width").first()
    return first["width"] if first else 0


def sample(vectors: DataFrame, id_col: str, column: str, rows: int, width: int) -> np.ndarray:
    """Up to rows valid vectors, by hash of the id."""
    picked = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(id_col, F.lit(11)), id_col).select(column).limit(rows).toArrow()
    return valid(picked.column(0).combine_chunks() if picked.num_rows else pa.array([], pa.list_(pa.float64())), width)[1]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).reshape(-1)), x.shape[1]).cast(pa.list_(pa.from_numpy_dtype(x.dtype)))


def joined(pieces: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = list(pieces)
    return pa.Table.from_batches(got).combine_chunks() if got else None
