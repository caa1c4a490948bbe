"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. They are rotated and split into equal blocks; of a
linked pair at least one block lies within its proportional share of that budget. So each block is range-joined by
itself, and the union of candidates is verified exactly on the original vectors.

A block's range join: a median tree, built from a bounded sample, cuts the block's space into leaves. A vector is at home
in one leaf and visits later leaves that its ball reaches, by the sum of squared overshoots. A leaf's vectors are dealt into chunks
of bounded bytes, and each task joins two chunks; its size is bounded, whatever the skew, and it puts out counts per vector and a
spanning forest, never pairs. A pair is counted in the first of its blocks that is within budget, and so once.
Vectors with equal components are one class, whose size weighs in the counts, so exact copies cost one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

#: Sampled vectors for the trees at most, and for each chunk's worth of rows; bytes of a chunk in double precision.
SAMPLE, LEAF_SAMPLE, CHUNK_BYTES = 1 << 16, 64, 8 << 20
#: Slack of squared distances against rounding.
SLACK = 1e-9


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated unit vectors; einsum's sums don't depend on how many rows come at once, so blocks agree between tasks."""
    unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.einsum("ij,kj->ik", unit, turn)


def tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete median tree in heap order: (dimension, cut) of each inner node; a node's points are cut where they spread most."""
    nodes: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    parts = [points]
    for at in range(len(nodes)):
        p = parts[at]
        dim = int(np.argmax(p.var(0))) if len(p) else 0
        cut = float(np.median(p[:, dim])) if len(p) else 0.0
        nodes[at] = (dim, cut)
        right = p[:, dim] > cut
        parts += [p[~right], p[right]]
    return nodes


def leaves(points: np.ndarray, nodes: list[tuple[int, float]], depth: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): the leaf of each point, and later leaves within the budget of it."""
    row, at, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    over = np.zeros((len(points), points.shape[1]))  # of each dimension, the overshoot so far
    cuts = np.array([c for _, c in nodes] or [0.0])
    dims = np.array([d for d, _ in nodes] or [0])
    for _ in range(depth):
        gap = points[row, dims[at]] - cuts[at]
        own = 2 * at + 1 + (gap > 0)
        far = over.copy()
        i = np.arange(len(row))
        far[i, dims[at]] = np.maximum(far[i, dims[at]], np.abs(gap))
        reach = (far**2).sum(1) <= budget
        other = 4 * at + 3 - own
        row, at, home, over = np.concatenate((row, row[reach])), np.concatenate((own, other[reach])), np.concatenate((home, np.zeros(reach.sum(), bool))), np.concatenate((over, far[reach]))
    at = at - ((1 << depth) - 1)
    own_leaf = np.zeros(len(points), np.int64)
    own_leaf[row[home]] = at[home]
    keep = home | (at < own_leaf[row])  # a pair across leaves meets where the one is at home in the earlier leaf
    return row[keep], at[keep], home[keep]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", cosine: float = 0.95, blocks: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    n_links counts the other vectors with at least the given cosine, computed in double precision. Vectors that are
    null, empty, zero or hold null, NaN or infinite components link with nothing, and so do those of another width than the
    commonest (the smaller one of equally common ones). Every row is a vector of its own, also where rows share an id: equal vectors are linked with one another.
    Rows without an id link with nothing and are kept. An empty table gives an empty result; other columns are not read.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v"))
    vectors = vectors.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v")))
    number = "float" if dict(vectors.dtypes)["v"] == "array<float>" else "double"  # components travel as they came
    width = V.width_of(vectors, "v")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = V.valid(b.column(1), width)
            x = (x + 0.0).astype(number if number == "double" else np.float32)  # -0 counts as 0
            keys, size = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            keys[rows], size[rows] = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], width
            bound = np.concatenate(([0], np.cumsum(size)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(x.reshape(-1)))], ["vec_id", "key", "x"])

    if not width:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = C.stored(vectors.mapInArrow(keyed, f"vec_id long, key binary, x array<{number}>"), "vectors")
    classes = C.stored(good.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"), F.first("x").alias("x")).withColumn("rep", F.monotonically_increasing_id()), "classes")  # rep: a class's number, fixed by being stored
    n, chunk_rows = classes.count(), max(256, CHUNK_BYTES // (8 * width))
    turn, size = rotation(width), -(-width // blocks)
    cut = [slice(k * size, min((k + 1) * size, width)) for k in range(blocks) if k * size < width]
    budget = (2 - 2 * cosine + SLACK) / len(cut)
    picked = V.sample(classes, "rep", "x", min(SAMPLE, max(4096, LEAF_SAMPLE * 2 * n // chunk_rows)), width)
    depth = max(0, min(int(np.log2(max(n / chunk_rows, 1))), int(np.log2(max(len(picked) / LEAF_SAMPLE, 1)))))
    plans = []
    for c in cut:
        points = rotated(picked, turn)[:, c] if len(picked) else np.zeros((0, c.stop - c.start))
        nodes = tree(points, depth)
        _, leaf, home = leaves(points, nodes, depth, budget)
        share = lambda mask: np.maximum(1, np.ceil(np.bincount(leaf[mask], minlength=1 << depth) / max(len(picked), 1) * n / chunk_rows)).astype(int)  # noqa: B023, E731
        plans.append((c, nodes, share(home), share(~home)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = V.matrix(part.column(2), width)
                turned = rotated(x, turn)
                mixed = C.mix(part.column(0).to_numpy().astype(np.int64).view(np.uint64))
                for k, (c, nodes, homes, visits) in enumerate(plans):
                    row, leaf, home = leaves(turned[:, c], nodes, depth, budget)
                    chunk = np.where(home, (mixed[row] % homes[leaf].astype(np.uint64)).astype(np.int64), homes[leaf] + (mixed[row] % visits[leaf].astype(np.uint64)).astype(np.int64))
                    out = []  # (row, leaf, first chunk, second chunk, side)
                    for r, f, g, h in zip(row.tolist(), leaf.tolist(), chunk.tolist(), homes[leaf].tolist(), strict=True):
                        if g < h:
                            out += [(r, f, g, o, 0) for o in range(g, h + int(visits[f]))]
                            out += [(r, f, o, g, 1) for o in range(g)]
                        else:
                            out += [(r, f, o, g, 1) for o in range(h)]
                    if out:
                        r, f, i, j, side = (np.array(z) for z in zip(*out, strict=True))
                        take = pa.array(r)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), k)), pa.array(f), pa.array(i), pa.array(j), pa.array(side), part.column(0).take(take), part.column(1).take(take), part.column(2).take(take)], ["block", "leaf", "i", "j", "side", "rep", "many", "x"])

    def join(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = V.joined(pieces)
        if got is None:
            return
        k, i, j = (got.column(c)[0].as_py() for c in ("block", "i", "j"))
        order = np.argsort(got.column("rep").to_numpy(), kind="stable")
        got = got.take(pa.array(order))
        side, rep, many = (got.column(c).to_numpy() for c in ("side", "rep", "many"))
        x = V.matrix(got.column("x").combine_chunks(), width)
        turned = rotated(x, turn)
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        links = np.zeros(len(rep), np.int64)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        # a pair within budget has a.b - |b|^2 / 2 >= (|a|^2 - budget) / 2: one product in single precision, with slack
        b = turned[right][:, cut[k]]
        b = np.column_stack([b, -0.5 * (b**2).sum(1)]).astype(np.float32)
        step = max(1, 4_000_000 // max(len(right), 1))
        for s in range(0, len(left), step):
            a = turned[left[s : s + step]][:, cut[k]]
            near = np.column_stack([a, np.ones(len(a))]).astype(np.float32) @ b.T >= (0.5 * ((a**2).sum(1) - budget) - 1e-5).astype(np.float32)[:, None]
            if i == j:
                near &= np.arange(len(right))[None] > np.arange(s, s + len(a))[:, None]
            p, q = np.nonzero(near)
            for t in range(0, len(p), 200_000):
                u, v = left[s + p[t : t + 200_000]], right[q[t : t + 200_000]]
                share = np.stack([((turned[u][:, c] - turned[v][:, c]) ** 2).sum(1) for c in cut], 1) <= budget
                first = share.argmax(1) == k
                u, v = u[first & share.any(1)], v[first & share.any(1)]
                ok = np.einsum("ij,ij->i", x[u], x[v]) / (norm[u] * norm[v]) >= cosine
                u, v = u[ok], v[ok]
                np.add.at(links, u, many[v])
                np.add.at(links, v, many[u])
                lone = np.ones(len(u), bool)
                if len(u) > 1000:  # most links of a dense group tell nothing new: drop those inside one component
                    root = np.array([find(z) for z in range(len(rep))])
                    lone = root[u] != root[v]
                for y, z in zip(u[lone].tolist(), v[lone].tolist(), strict=True):
                    if (y := find(y)) != (z := find(z)):
                        parent[max(y, z)] = min(y, z)
        linked = np.flatnonzero(links)
        root = np.array([find(z) for z in linked.tolist()], int)
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(links[linked]), pa.array(rep[root] if len(root) else rep[:0])], ["rep", "links", "root"])

    schema = f"block long, leaf long, i long, j long, side long, rep long, many long, x array<{number}>"
    spread = classes.select("rep", "many", "x").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = spread.mapInArrow(dealt, schema)

    def grouped(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(join(iter(table.to_batches()))) or [pa.RecordBatch.from_pylist([], pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))])

    found = C.stored(parts.groupBy("block", "leaf", "i", "j").applyInArrow(grouped, "rep long, links long, root long"), "links")
    comps = C.components(found.select("rep", "root").where("rep <> root"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("key", "first", "rep", "many").join(counts, "rep", "left").join(comps, F.col("rep") == comps["node"], "left")
    of_class = C.stored(of_class.select("key", "first", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "rep").alias("group")), "labels")
    smallest = of_class.groupBy("group").agg(F.min("first").alias("component"))
    of_class = of_class.join(smallest, "group").select("key", "many", "links", "component")
    out = C.with_class(good.select("vec_id", "key"), of_class, ["key"])
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
