"""Late interaction: the sum over query rows of the best inner product with a document's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def maxsim(query: np.ndarray, doc: np.ndarray) -> float:
    """0 if either has no rows, before widths are compared; rows whose best product isn't finite are left out."""
    if not len(query) or not len(doc):
        return 0.0
    if query.shape[1] != doc.shape[1]:
        raise ValueError(f"dimension mismatch: {query.shape[1]} and {doc.shape[1]}")
    products = query @ doc.T
    products[np.isnan(products)] = -np.inf
    best = products.max(1)
    return float(best[np.isfinite(best)].sum())


def maxsim_batch(query: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """maxsim of each document, whose rows are rows[bound[i]:bound[i + 1]], by one product with all rows; widths are compared first."""
    n = len(bound) - 1
    out = np.zeros(n)
    if not len(query) or not len(rows):
        return out
    if query.shape[1] != rows.shape[1]:
        raise ValueError(f"dimension mismatch: {query.shape[1]} and {rows.shape[1]}")
    products = rows @ query.T
    products[np.isnan(products)] = -np.inf
    some = np.flatnonzero(np.diff(bound))
    best = np.maximum.reduceat(products, bound[some], axis=0)
    out[some] = np.where(np.isfinite(best), best, 0.0).sum(1)
    return out


def _documents(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, rows, bound) of runs of documents of one width, by their Arrow buffers; null documents have no rows."""
    column = column.cast(pa.list_(pa.list_(pa.float64())))
    many = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    width = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bound = np.concatenate(([0], np.cumsum(many)))
    of = np.array([width[bound[i]] if many[i] else -1 for i in range(len(many))])
    if any((width[bound[i] : bound[i + 1]] != of[i]).any() for i in np.flatnonzero(np.add.reduceat(np.append(width, 0), bound[:-1]) != many * of) if many[i]):
        raise ValueError("a document has rows of several widths")
    flat, at = inner.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(width)))
    i = 0
    while i < len(many):
        j, size, wide = i, 0, -1
        while j < len(many) and (j == i or size < most) and (of[j] < 0 or wide < 0 or of[j] == wide):
            wide = of[j] if of[j] >= 0 else wide
            size += at[bound[j + 1]] - at[bound[j]]
            j += 1
        yield i, j, flat[at[bound[i]] : at[bound[j]]].reshape(bound[j] - bound[i], max(wide, 0)), bound[i : j + 1] - bound[i]
        i = j


def score(docs: DataFrame, query: np.ndarray, id_col: str = "doc_id", column: str = "embedding", mean: bool = False) -> DataFrame:
    """(id_col, score) of array<array<float>> documents; mean divides by the query's rows. No shuffle."""
    query = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, rows, bound in _documents(b.column(1)):
                s = maxsim_batch(query, rows, bound)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s / len(query) if mean and len(query) else s)], [id_col, "score"])

    return docs.select(id_col, column).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double")
