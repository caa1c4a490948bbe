"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A text's set holds its distinct word shingles (words: runs without ASCII white space, A-Z lower-cased). The steps:

1. Every text gets its set's size, a 128-bit order-free digest of the set, and band keys of its SuperMinHash
   signature. Texts with equal digests form a class, whose representative is its smallest id; only
   representatives go on, so a group of exact copies costs one row however large it is.
2. In each band bucket every member is paired with one leader (a star, linear in the bucket) and the pair is
   verified on full sets. Each bucket draws its leader by its own hash, so that a member of a large group meets many
   different leaders. Verified links give first components.
3. In buckets whose members still lie in several components, the pairs across components that weren't tried are
   verified inside a join by bucket, which puts out links only. Together the steps find every component that verification of all pairs in all buckets would.

Two sets with similarity s share a bucket with probability 1 - (1 - s^rows)^bands: 0.999997 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64

#: Elements times signature slots of permutation state held at once.
STATE = 1 << 16


def shingle_hashes(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct shingles, sorted within a text, and the n + 1 bounds."""
    n = len(off) - 1
    raw = C.LOWER[raw]
    start, end, doc = C.spans(raw, off)
    word = C.span_hashes(C.prefix_sums(raw), start, end)
    bound = C.row_bounds(doc, n)
    out, sizes = [], np.zeros(n, np.int64)
    factor = [U64(int(x) | 1) for x in np.random.default_rng(width).integers(1, 1 << 62, width)]
    for i in range(n):
        w = word[bound[i] : bound[i + 1]]
        if not len(w):
            continue
        k = min(width, len(w))
        h = np.zeros(len(w) - k + 1, U64)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * factor[j]
        out.append(np.unique(C.mix(h + U64(k))))
        sizes[i] = len(out[-1])
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate(([0], np.cumsum(sizes)))


def superminhash(items: np.ndarray, bound: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (texts x slots). A value is (rank << 32 | uniform): each item deals its ranks 0, 1, 2... to the slots
    by a random permutation, a slot keeps its least value, and a text stops at the first rank above all its slots."""
    n = len(bound) - 1
    full = U64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n, slots), full, U64)
    size = np.diff(bound)
    i = 0
    while i < n:  # texts in groups of up to STATE items
        j = max(i + 1, int(np.searchsorted(bound, bound[i] + STATE, side="right")) - 1)
        h, doc = items[bound[i] : bound[j]], np.repeat(np.arange(i, j), size[i:j])
        state = None
        for rank in range(slots):
            z = C.mix(h + U64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            slot = (rank + (((z & U64(0xFFFFFFFF)) * U64(slots - rank)) >> U64(32)).astype(np.int64)).astype(np.int64)
            if state is None:
                target = slot
            else:
                row = np.arange(len(h))
                target = state[row, slot].astype(np.int64)
                state[row, slot] = state[:, rank]
            np.minimum.at(sig.reshape(-1), doc * slots + target, (U64(rank) << U64(32)) | (z >> U64(32)))
            going = (sig[i:j].max(1) >= (U64(rank + 1) << U64(32)))[doc - i]
            if not going.any():
                break
            h, doc = h[going], doc[going]
            if state is None:
                state = np.tile(np.arange(slots, dtype=np.uint16), (len(h), 1))
                state[np.arange(len(h)), slot[going]] = 0
            else:
                state = state[going]
        i = j
    return sig


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands): size, digest and band keys of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (U64(2) * np.arange(1, rows + 1, dtype=U64) + U64(1)) * U64(0xD6E8FEB86659FD93)
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(1)):
                items, bound = shingle_hashes(raw, off, width)
                n, size = j - i, np.diff(bound)
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(C.mix(items ^ U64(k)), dtype=U64))) for k in (0x5851F42D, 0x14057B7E)]
                d1, d2 = (s[bound[1:]] - s[bound[:-1]] for s in sums)
                sig = superminhash(items, bound, bands * rows).reshape(n, bands, rows)
                key = C.mix((sig * turns).sum(2, dtype=U64) + np.arange(bands, dtype=U64) * U64(0xA0761D6478BD642F))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))), pa.int32()), pa.array(key[size > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).cast(pa.int64()), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), lists], ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


#: Items of the sets of leaders of large buckets up to which these sets are broadcast (8 bytes each).
HOT_ITEMS = 4 << 20
#: Words of 64 bits of a set's bit map.
MAP_WORDS = 16


def bit_maps(items: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Texts x MAP_WORDS: a bit for each value of the items' top bits. Two sets differ in at least as many items as their maps in bits."""
    n, bits = len(bound) - 1, 64 * MAP_WORDS
    at = (items >> U64(64 - (bits.bit_length() - 1))).astype(np.int64) + np.repeat(np.arange(n), np.diff(bound)) * bits
    flag = np.zeros(n * bits, np.uint8)
    flag[at] = 1
    return np.packbits(flag.reshape(-1, 8), axis=1).reshape(-1).view(np.int64).reshape(n, MAP_WORDS)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, items, map): the full sets of docs (id, text), and their bit maps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(1)):
                items, bound = shingle_hashes(raw, off, width)
                maps = pa.ListArray.from_arrays(pa.array(MAP_WORDS * np.arange(j - i + 1), pa.int32()), pa.array(bit_maps(items, bound).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(items.view(np.int64))), maps], ["id", "items", "map"])

    return docs.mapInArrow(run, "id long, items array<long>, map array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Null and empty texts, and texts without a word, have empty sets and link with nothing; fewer words than the
    width make one shingle of all of them. Rows that share an id also share its links. Rows without an id belong to the component of
    rows with an equal set, if one of these has an id, and link with nothing else; those of no component have a null component_id and are kept.
    An empty table gives an empty result; other columns of docs are not read.
    """
    sigs = C.stored(signatures(docs, id_col, text_col, width, bands, rows), "sigs")
    classes = sigs.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.first("bands").alias("bands"))
    classes = C.stored(classes.where("rep is not null"), "classes")
    posted = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = C.stored(posted.groupBy("key").agg(F.min_by("rep", F.xxhash64("key", "rep")).alias("leader"), F.count("*").alias("members")).where("members > 1"), "buckets")
    members = C.with_class(posted, buckets.withColumn("many", F.col("members")), ["key"]).where("leader is not null")
    members = C.stored(members, "members")
    ids = C.stored(members.select("rep").distinct(), "ids")
    n_ids = ids.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = C.stored(shingle_sets(texts.join(C.small(ids, n_ids), texts["id"] == ids["rep"], "left_semi"), width), "sets")

    def alike(x: str, y: str) -> Column:
        """Whether the sets of two sides (items, map) are similar enough: first by their sizes, then by a lower bound of
        the number of items that only one of them holds, then exactly."""
        both_sizes = F.size(f"items_{x}") + F.size(f"items_{y}")
        sizes = 100 * F.least(F.size(f"items_{x}"), F.size(f"items_{y}")) >= percent * F.greatest(F.size(f"items_{x}"), F.size(f"items_{y}"))
        apart = sum((F.bit_count(F.get(f"map_{x}", F.lit(k)).bitwiseXOR(F.get(f"map_{y}", F.lit(k)))) for k in range(MAP_WORDS)), F.lit(0))
        both = F.size(F.array_intersect(f"items_{x}", f"items_{y}"))
        return sizes & ((100 + percent) * apart <= (100 - percent) * both_sizes) & (100 * both >= percent * (both_sizes - both))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (x: a leader, y) whose full sets are similar enough. A leader of more than C.HOT_ROWS members stands in as many
        pairs; such leaders are few, and their sets are broadcast if their counted items allow."""
        pairs = C.stored(pairs, "pairs")
        one, two = (sets.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}"), F.col("map").alias(f"map_{k}")) for k in "yx")
        found = pairs.join(one, "y")
        hot = C.stored(two.join(F.broadcast(buckets.where(F.col("members") > C.HOT_ROWS).select(F.col("leader").alias("x")).distinct().limit(C.BROADCAST_ROWS)), "x", "left_semi"), "hot")
        if 0 < (hot.agg(F.sum(F.size("items_x"))).first()[0] or 0) <= HOT_ITEMS:
            known = F.broadcast(hot.select("x").distinct())
            found = found.join(F.broadcast(hot), "x").unionByName(found.join(known, "x", "left_anti").join(two, "x"))
        else:
            found = found.join(two, "x")
        return found.where(alike("x", "y")).select("x", "y").distinct()

    stars = members.where("rep <> leader").select(F.col("leader").alias("x"), F.col("rep").alias("y")).distinct()
    links = C.stored(verified(stars), "links")
    comps = C.stored(C.components(links), "comps")
    # pairs across components, in buckets that still hold several
    placed = members.where("members > 2").join(comps, members["rep"] == comps["node"], "left").select("key", "leader", "rep", F.coalesce("component", "rep").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    placed = placed.where("rep <> leader").join(split, "key", "left_semi").join(sets, F.col("rep") == sets["id"]).select("key", "rep", "c", "items", "map")
    placed = C.stored(placed, "placed")
    # compared inside the join, bucket by bucket: only links come out of it, and a skewed bucket can be split
    left, right = (placed.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "c", "items", "map")]) for side in "xy")
    across = left.join(right, (left["key"] == right["key"]) & (F.col("rep_x") < F.col("rep_y")) & (F.col("c_x") != F.col("c_y")) & alike("x", "y"))
    more = C.stored(across.select(F.col("rep_x").alias("x"), F.col("rep_y").alias("y")).distinct(), "links")
    if not more.isEmpty():
        comps = C.stored(C.components(links.union(more)), "comps")
    of_class = C.stored(classes.join(comps, classes["rep"] == comps["node"], "left").select("d1", "d2", "n_shingles", "many", F.coalesce("component", "rep").alias("component")), "labels")
    keyed = sigs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1")).alias("d1"), "d2")
    out = C.with_class(keyed, of_class, ["d1", "d2", "n_shingles"])
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
