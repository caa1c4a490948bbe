"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. The index deals all vectors into shards of bounded size; a shard holds an inverted
file per pivot with the vectors that have it among their first `prefix`, and at which rank. A query adds up, over its own
first pivots' files, how much less than the largest the footrule distance to each vector is; the vectors with the least
distance, a fixed share of the shard, are reranked by their exact inner product.

For the largest inner product, norms count: vectors get one more component that makes all norms equal, queries get zero
there, so that near means a large product. Query blocks meet shards as whole blocks; a shard's best go on to a merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: Rows of a shard and of a query block.
SHARD, QUERIES = 8192, 2048


def ranks(x: np.ndarray, pivots: np.ndarray, extra: np.ndarray, pivot_extra: np.ndarray, prefix: int) -> np.ndarray:
    """For each vector its first pivots, nearest first."""
    near = x @ pivots.T + extra[:, None] * pivot_extra[None]
    return np.argsort(-near, 1, kind="stable")[:, :prefix].astype(np.int32)


def diverse(x: np.ndarray, many: int, cosine: float = 0.7) -> np.ndarray:
    """Up to many rows, none of which points nearly the same way as an earlier one: a dense group gives one pivot, not a block of
    pivots whose ranks move together. Where too few differ, the rest are taken as they come."""
    unit = x / np.sqrt((x**2).sum(1))[:, None]
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) < many and (not kept or (unit[kept] @ unit[i]).max() < cosine):
            kept.append(i)
    rest = [i for i in range(len(x)) if i not in set(kept)] if len(kept) < many else []
    return x[(kept + rest)[:many]]


class Shard:
    """Inverted files over one shard's vectors, sorted by id. A pivot's file tells of each vector how early the pivot comes in its
    order: prefix - rank, 0 if not among the first. With a third of all vectors in every file, files are held densely, a byte or two a vector."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray, top: float, prefix: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.prefix = ids[order], x[order], prefix
        extra = np.sqrt(np.maximum(top**2 - (self.x**2).sum(1), 0))
        first = ranks(self.x, pivots, extra, pivot_extra, prefix)
        self.files = np.zeros((len(pivots), len(ids)), np.uint8 if prefix < 256 else np.uint16)
        self.files[first, np.arange(len(ids))[:, None]] = prefix - np.arange(first.shape[1])

    def search(self, first: np.ndarray, query: np.ndarray, own: int, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best among those that the footrule ranks first: a shared pivot saves prefix less the later of its two ranks."""
        n = len(self.ids)
        mine = (self.prefix - np.arange(len(first))).astype(self.files.dtype)
        saved = np.minimum(self.files[first], mine[:, None]).sum(0, dtype=np.uint32).astype(np.int64)
        m = min(n, max(least, int(np.ceil(share * n))))
        key = -saved * n + np.arange(n)  # ties to the smaller id
        near = np.argpartition(key, m - 1)[:m] if m < n else np.arange(n)
        near = near[self.ids[near] != own]
        score = np.einsum("ij,j->i", self.x[near], query)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][best], score[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", column: str = "embedding", pivots: int = 256, prefix: int = 96, share: float = 0.15, least: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k found with the largest inner product, ties to the smaller id.

    queries has (id_col, column); a query's own id is no candidate. Pivots are up to `pivots` vectors of four times as many,
    by hash of the id; every vector is indexed. A shard reranks the given share of its vectors, and at least `least`. Null, empty
    and zero vectors, those with null, NaN or infinite components, those of another width than the commonest, and rows without an
    id take no part. Rows of vectors that share an id are candidates each; a query id is asked once, with the smallest of its vectors.
    Pivots at equal nearness rank by their number. An empty table, or one without queries, gives an empty result; other columns are not read.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null")
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(column).alias("v")).where("id is not null")
    width = V.width_of(vectors, "v")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = V.valid(b.column(1), width)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), V.lists(x), pa.array((x**2).sum(1))], ["id", "x", "norm2"])

    schema = "id long, x array<double>, norm2 double"
    index = C.stored(vectors.mapInArrow(clean, schema), "index")
    asked = queries.mapInArrow(clean, schema).groupBy("id").agg(F.min("x").alias("x"))
    asked = C.stored(asked, "asked")
    n, top2 = index.agg(F.count("*"), F.max("norm2")).first()
    q = asked.count()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or not q or not width:
        return empty
    top = float(np.sqrt(top2))
    pivot = diverse(V.sample(index, "id", "x", 4 * pivots, width), pivots)
    pivot_extra = np.sqrt(np.maximum(top2 - (pivot**2).sum(1), 0))
    first_n = min(prefix, len(pivot))
    shards, groups = -(-n // SHARD), -(-q // QUERIES)

    def pair(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        x = V.matrix(table.column("x").combine_chunks(), width)
        mine, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = []
        if len(mine) and len(ask):
            shard = Shard(ids[mine], x[mine], pivot, pivot_extra, top, first_n)
            first = ranks(x[ask], pivot, np.zeros(len(ask)), pivot_extra, first_n)
            for a, f in zip(ask.tolist(), first, strict=True):
                found, score = shard.search(f, x[a], int(ids[a]), k, share, least)
                out.append((np.full(len(found), ids[a]), found, score))
        cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    dealt = lambda df, many, other, side, own, cross: df.select(F.pmod(F.xxhash64("id"), F.lit(many)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(cross), F.lit(side).alias("side"), "id", "x")
    cells = dealt(index, shards, groups, 0, "shard", "block").unionByName(dealt(asked, groups, shards, 1, "block", "shard"))
    found = cells.groupBy("shard", "block").applyInArrow(pair, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
