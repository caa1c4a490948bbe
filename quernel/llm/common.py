"""Shared parts of the training-data operators: stored tables, text kernels on Arrow buffers, folds, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at once; one longer text is taken whole.
CHUNK_BYTES = 1 << 20
#: Rows of a key table (8 to 24 bytes each) up to which it may be broadcast.
BROADCAST_ROWS = 500_000
#: Rows of one class from which on its rows are not shuffled by its key.
HOT_ROWS = 10_000

_local: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where the session names none and runs in one process; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quernel-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage is cut, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> list[str]:
    """The tables that stored has written in this process and that weren't released, in order."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes such tables. Results that still read them must have been written or collected."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its counted rows are within the limit; otherwise left to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % k


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], many: str = "many", hot: int | None = None) -> DataFrame:
    """rows left-joined to their classes on keys, of which many says how many rows each holds. Classes of more than hot rows (HOT_ROWS)
    are few, so their rows meet them in a broadcast (if their counted number allows) and don't land in one task; rows with a null key stay out of the shuffle."""
    hot = HOT_ROWS if hot is None else hot
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    large = classes.where(F.col(many) > hot).drop(many)
    n, rest, more = large.count(), classes.drop(many), [c for c in classes.columns if c not in (*keys, many)]
    out = rows.where(f"NOT ({known})").select("*", *[F.lit(None).cast(dict(classes.dtypes)[c]).alias(c) for c in more])
    rows = rows.where(known)
    if 0 < n <= BROADCAST_ROWS:
        out = out.unionByName(rows.join(F.broadcast(large), keys))
        rows = rows.join(F.broadcast(large.select(keys)), keys, "left_anti")
        rest = classes.where(F.col(many) <= hot).drop(many)
    return out.unionByName(rows.join(rest, keys, "left"))


# ---------------------------------------------------------------- text kernels

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: all but space, tab, newline, vertical tab, form feed, carriage return.
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
#: Letters: ASCII letters and all bytes of longer UTF-8 sequences.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def arrow_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts up to limit bytes together."""
    raw, off = arrow_text(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(raw: np.ndarray, off: np.ndarray, member: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of member bytes."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = member[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[:-1][off[:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[1:][off[1:] > 0] - 1
    last[cuts] = inside[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span follows (polynomial over random byte values, modulo 2^64)."""
    if len(_powers[0]) < len(raw) + 1:
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(len(raw) + 1, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    elif len(raw) <= 2 * CHUNK_BYTES < len(_powers[0]) // 2:  # what one very long text needed isn't kept
        _powers[:] = [p[: 2 * CHUNK_BYTES + 1].copy() for p in _powers]
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE_VALUES[raw] * _powers[0][: len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes."""
    return mix((sums[end] - sums[start]) * _powers[1][start] + (end - start).astype(U64))


def row_bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 bounds of each text's items in a sorted list of text numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


# ---------------------------------------------------------------- components


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: at most one link per node goes out, towards the smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x] = root
            x = p
        return root

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (x := find(x)) != (y := find(y)):
                parent[max(x, y)] = min(x, y)
    rows = [(x, find(x)) for x in parent]
    for i in range(0, len(rows), 100_000):
        u, v = zip(*rows[i : i + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame, salts: int = 16) -> DataFrame:
    """(node, component): the smallest node reachable from each node of links (two long columns).

    Union-find in each partition leaves forests; alternating large and small stars joins them. A round's join is
    salted on the hub, so that a node with a large share of all links doesn't land in one task. The rounds, about
    the logarithm of the longest path, end when no link changes; nothing but two sums reaches the driver.
    """
    a, b = links.columns
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    tree = stored(links.mapInArrow(_forest, "u long, v long"), "forest")  # u > v from here on

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select(F.col("v"), F.col("u")))
        hub = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hub = hub.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        e = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        out = e.join(hub, ["u", "salt"])
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.where("u > v").distinct()

    def sums(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    before = sums(tree)
    while before[0]:
        tree = stored(star(star(tree, True), False), "stars")
        after = sums(tree)
        if after == before:
            break
        before = after
    return tree.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
