"""LM scoring by context-tree weighting over bytes.

A byte is eight binary choices down a tree of 255 nodes; each node has its own context tree over the preceding bytes, up
to `depth` of them. A context's binary counts give a Krichevsky-Trofimov estimate; weighting mixes each context with
its longer contexts, bottom up, in the log domain:  Pw = 1/2 Pkt + 1/2 prod Pw(longer).  The trained model keeps for
every context its predictive estimate and the posterior weight of stopping there; a text's probability mixes them from
the empty context down to the longest one that training saw. Texts are A-Z lower-cased and close with an end mark.

Training counts all (depth + 1)-grams and words of all training texts, in each task first, then by a shuffle that grows
with the input. No node is dropped or approximated for size: grams are dealt into buckets by their NEAR next bytes, and
whatever a text asks for meets its bucket's training grams in a shuffle, where a task builds all contexts of NEAR bytes
or more and scores by them. What is broadcast is bounded: the contexts shorter than NEAR, the commonest grams with their
scores, and the commonest words for the base score. Grams and words travel as packed blobs of a bucket's sorted keys.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64

#: The end mark and the bytes before a text; it stands in no UTF-8 text.
EDGE = 0xFF
#: Grams that are sorted at once; distinct grams or words, or asked pairs, that a task gathers before it passes them on.
SORTED, GATHERED = 1 << 22, 3 << 20
#: Commonest words that are broadcast; the others meet their counts in a shuffle.
HOT_WORDS = 1 << 18
#: Commonest training grams whose scores are broadcast (16 bytes each); the others meet theirs in a shuffle.
HOT_GRAMS = 1 << 21
#: Bytes next to the coded one by which grams meet in a task.
NEAR = 3
#: Fractions of a natural log in which sums of logs pass through a shuffle.
FIXED = 1 << 20
#: Kinds of rows: grams, words, numbers of texts, scored texts.
GRAM, WORD, TEXTS, SCORED = 0, 1, 2, 3
#: Classes of counts, eight to a doubling.
CLASSES = 8 * 48

_BITS = np.arange(7, -1, -1)


def grams(raw: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and end mark with the depth bytes before it, packed; and their text numbers."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    text = np.full(len(raw) + depth * (n + 1), EDGE, np.uint8)
    at = np.arange(len(raw)) + depth * (doc + 1)
    text[at] = raw
    ends = off[1:] + depth * np.arange(1, n + 1)
    at, doc = np.concatenate((at, ends)), np.concatenate((doc, np.arange(n)))
    code = text.astype(U64)
    for k in range(1, depth + 1):
        code[k:] |= text[:-k].astype(U64) << U64(8 * k)
    return code[at], doc


def choices(code: np.ndarray) -> np.ndarray:
    return ((code & U64(255)).astype(np.int64)[:, None] >> _BITS[None]) & 1


def near_bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (C.mix(code >> U64(8) & U64((1 << 8 * NEAR) - 1)) % U64(buckets)).astype(np.int64)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (word % U64(buckets)).astype(np.int64)


# ---------------------------------------------------------------- packed columns


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal values in sorted keys begin."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def pack(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted keys (as differences) and further columns as bytes, byte planes apart, so that high zero bytes vanish in compression."""
    out = [np.array([len(keys)], "<u8").tobytes()]
    for x in (np.diff(keys, prepend=U64(0)), *(m.astype(U64) for m in more)):
        low = x.min() if len(x) else U64(0)
        x = x - low
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [np.array([low, width], "<u8").tobytes(), x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    (n,), at, out = np.frombuffer(blob, "<u8", 1).tolist(), 8, []
    for _ in range(columns):
        low, width = np.frombuffer(blob, "<u8", 2, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, : int(width)] = np.frombuffer(blob, np.uint8, n * int(width), at + 16).reshape(int(width), n).T
        out.append(x.view("<u8").reshape(-1) + low)
        at += 16 + n * int(width)
    return [np.cumsum(out[0]), *out[1:]]


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by bucket; their order within a bucket stays."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.append(_starts(bucket), len(bucket)).tolist()
    for i, j in itertools.pairwise(cuts):
        yield int(bucket[i]), [c[i:j] for c in columns]


def _grouped_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """Rows (kind, bucket, ...) of a sorted partition, by kind and bucket."""
    rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True))
    return itertools.groupby(rows, key=lambda r: (r[0], r[1]))


class _Counts:
    """Distinct keys with counts, merged when many have gathered."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw_size = self.size = 0

    def see(self, keys: np.ndarray) -> None:
        """Keys that may repeat."""
        self.raw.append(keys)
        self.raw_size += len(keys)
        if self.raw_size >= SORTED:
            self.sort()

    def sort(self) -> None:
        if self.raw:
            keys = np.concatenate(self.raw)
            self.raw, self.raw_size = [], 0
            keys.sort()
            first = _starts(keys)
            self.add(keys[first], np.diff(np.append(first, len(keys))))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys with their counts."""
        self.parts.append((keys, counts.astype(np.int64)))
        self.size += len(keys)
        if self.size > GATHERED and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, with counts."""
        self.sort()
        if len(self.parts) != 1:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64))
            self.parts = [_grouped(keys, counts)]
            self.size = len(self.parts[0][0])
        return self.parts[0]

    def full(self) -> bool:
        return self.size > GATHERED // 2


def count_class(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(c, 1)) * 8), CLASSES - 1).astype(np.int64)


def _buckets(df: DataFrame) -> int:
    """As many buckets as a shuffle has partitions, so that each partition holds one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _packed(kind: int, blobs: Iterator[tuple[int, bytes]], limit: int = 4 << 20) -> Iterator[tuple[int, pa.Array, pa.Array, pa.Array]]:
    """Columns kind, bucket and blob, and their length, in batches of up to limit bytes or one blob."""
    got, size = [], 0
    for x in itertools.chain(blobs, [None]):
        if got and (x is None or size + len(x[1]) > limit):
            yield len(got), pa.array([kind] * len(got), pa.int32()), pa.array([b for b, _ in got], pa.int32()), pa.array([d for _, d in got], pa.binary())
            got, size = [], 0
        if x is not None:
            got.append(x)
            size += len(x[1])


def corpus_counts(texts: DataFrame, depth: int) -> DataFrame:
    """(kind, bucket, n, c, classes, blob): of each bucket of grams and of words of all rows of texts (text), the number of
    distinct ones, the sum of their counts, how many fall into each class of counts, and the keys and counts; the number of texts as c of kind TEXTS."""
    buckets = _buckets(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, texts = {GRAM: _Counts(), WORD: _Counts()}, 0
        deal = {GRAM: near_bucket, WORD: word_bucket}

        def rows(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = kept[kind].merge()
            kept[kind] = _Counts()
            for n, k, b, blob in _packed(kind, ((b, pack(*x)) for b, x in _dealt(deal[kind](keys, buckets), keys, counts))):
                yield pa.RecordBatch.from_arrays([k, b, pa.array(np.zeros(n, np.int64)), blob], ["kind", "bucket", "c", "blob"])

        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(0), 1 << 20):
                raw = C.LOWER[raw]
                kept[GRAM].see(grams(raw, off, depth)[0])
                start, end, _ = C.spans(raw, off)
                kept[WORD].see(C.span_hashes(C.prefix_sums(raw), start, end))
                texts += j - i
                for kind, c in kept.items():
                    if c.full() and len(c.merge()[0]) > GATHERED // 2:
                        yield from rows(kind)
        for kind in kept:
            yield from rows(kind)
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.array([0], pa.int32()), pa.array([texts], pa.int64()), pa.array([b""], pa.binary())], ["kind", "bucket", "c", "blob"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), rows in _grouped_rows(batches):
            every, c = _Counts(), 0
            for _, _, texts, blob in rows:
                c += texts
                if blob:
                    every.add(*unpack(blob, 2))
            keys, counts = every.merge()
            classes = np.bincount(count_class(counts), minlength=CLASSES) if len(keys) else np.zeros(CLASSES, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([c + int(counts.sum())], pa.int64()), pa.array([classes.tolist()], pa.list_(pa.int64())), pa.array([pack(keys, counts)], pa.binary())], ["kind", "bucket", "n", "c", "classes", "blob"])

    rows = texts.mapInArrow(run, "kind int, bucket int, c long, blob binary").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind", "bucket")
    return rows.mapInArrow(merged, "kind int, bucket int, n long, c long, classes array<long>, blob binary")


def least_class(counts: DataFrame, kind: int, limit: int) -> int:
    """The smallest class of counts whose keys and all commoner ones are at most limit."""
    rows = counts.where(F.col("kind") == kind).select(F.posexplode("classes").alias("k", "n")).where("n > 0").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out, total = CLASSES, 0
    for r in sorted(rows, key=lambda r: -r.k):
        total += r.n
        if total > limit:
            break
        out = r.k
    return out


# ---------------------------------------------------------------- the context tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 1/2, by Stirling's series after seven steps up."""
    down = np.ones_like(x)
    for k in range(7):
        down = down * (x + k)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


_SMALL = 128
_KT = _log_kt(*np.divmod(np.arange(_SMALL * _SMALL), _SMALL))


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones; of small counts from a table."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    small = (a < _SMALL) & (b < _SMALL)
    out = _KT[np.where(small, a * _SMALL + b, 0)]
    out[~small] = _log_kt(a[~small], b[~small])
    return out


def _grouped(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and sums by key."""
    order = np.argsort(key)
    key = key[order]
    first = _starts(key)
    return key[first], *(np.add.reduceat(s[order], first) if len(first) else s for s in sums)


def _weigh(kt: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the posterior weight of stopping there."""
    pw = np.logaddexp(kt, longer) + math.log(0.5)
    return pw, np.exp(math.log(0.5) + kt - pw)


def _nodes(code: np.ndarray) -> np.ndarray:
    """Keys of the eight choice nodes of each gram: its context and the node, packed."""
    node = (256 | (code & U64(255)).astype(np.int64)[:, None]) >> (_BITS + 1)[None]
    return (((code >> U64(8)) << U64(8))[:, None] | node.astype(U64)).reshape(-1)


def _levels(code: np.ndarray, count: np.ndarray, depth: int) -> tuple[list[tuple], tuple]:
    """From all training grams of some NEAR-byte contexts: their nodes (d, key, zeros, ones, stopping weight) by context
    length, longest first, and what they add to nodes of NEAR - 1 bytes (key, zeros, ones, log of the product of longer ones)."""
    n, bit = np.repeat(count, 8), choices(code).reshape(-1)
    key, a, b = _grouped(_nodes(code), n * (1 - bit), n * bit)
    pw, stop, levels = log_kt(a, b), np.ones(len(key)), []
    for d in range(depth, NEAR - 1, -1):
        levels.append((d, key, a, b, stop))
        key, a, b, longer = _grouped(key & U64((1 << (8 * d)) - 1), a, b, pw)  # without the farthest byte
        if d > NEAR:
            pw, stop = _weigh(log_kt(a, b), longer)
    return levels, (key, a, b, longer)


class Tables:
    """Nodes by context length: sorted keys, estimates of a one, stopping weights."""

    def __init__(self, depth: int) -> None:
        empty = (np.zeros(0, U64), np.zeros(0), np.zeros(0))
        self.depth, self.levels = depth, {d: empty for d in range(depth + 1)}

    def put(self, d: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> None:
        self.levels[d] = key, (b + 0.5) / (a + b + 1), stop

    def put_long(self, code: np.ndarray, count: np.ndarray) -> None:
        """The nodes of contexts of NEAR bytes or more of some buckets' training grams."""
        for d in range(NEAR, self.depth + 1):
            self.put(d, *(np.zeros(0, t) for t in (U64, int, int, float)))
        for level in _levels(code, count, self.depth)[0] if len(code) else ():
            self.put(*level)

    @classmethod
    def short(cls, counts: DataFrame, depth: int) -> Tables:
        """The nodes of contexts shorter than NEAR, at most 2^(8 NEAR) whatever the corpus, summed in the driver from those of NEAR - 1 bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0):
                    code, count = unpack(blob.as_py(), 2)
                    if len(code):
                        key, a, b, longer = _levels(code, count.astype(np.int64), depth)[1]
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(a), pa.array(b), pa.array(np.round(longer * FIXED))], ["key", "zeros", "ones", "longer"])

        nodes = counts.where(F.col("kind") == GRAM).select("blob").mapInArrow(run, "key long, zeros long, ones long, longer double")
        found = nodes.groupBy("key").agg(F.sum("zeros").alias("a"), F.sum("ones").alias("b"), F.sum("longer").alias("longer")).toArrow()
        key, a, b, longer = (found.column(k).to_numpy() for k in range(4))
        order, out = np.argsort(key.view(U64)), cls(depth)
        key, a, b, longer = key.view(U64)[order], a[order], b[order], longer[order] / FIXED
        for d in range(NEAR - 1, -1, -1) if len(key) else ():
            pw, stop = _weigh(log_kt(a, b), longer)
            out.put(d, key, a, b, stop)
            key, a, b, longer = _grouped(key & U64((1 << (8 * d)) - 1), a, b, pw)
        return out

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        return np.concatenate([self._log10(code[k : k + 50_000]) for k in range(0, len(code), 50_000)]) if len(code) else np.zeros(0)

    def _log10(self, code: np.ndarray) -> np.ndarray:
        bit, nodes = choices(code).reshape(-1), _nodes(code)
        left, mixed = np.ones(len(bit)), np.zeros(len(bit))
        last, live = np.full(len(bit), 0.5), np.ones(len(bit), bool)
        for d in range(self.depth + 1):
            keys, estimate, stop = self.levels[d]
            if not len(keys):
                break
            key = nodes & U64((1 << (8 * (d + 1))) - 1)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            live &= keys[place] == key
            p = estimate[place]
            w = np.where(live, stop[place], 0.0)
            mixed += left * w * p
            left *= 1 - w
            last = np.where(live, p, last)
        p = mixed + left * last  # what is left stops at the longest context seen
        return np.log10(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(1)


def common_grams(counts: DataFrame, short: Tables, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Training grams of a class of counts of at least least, in order, and their logs."""
    sent = counts.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            for blob in batch.column(0):
                code, count = unpack(blob.as_py(), 2)
                asked = code[count_class(count) >= least]
                if len(asked):
                    tables.put_long(code, count.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(tables.log10(asked))], ["key", "log"])

    got = counts.where(F.col("kind") == GRAM).select("blob").mapInArrow(run, "key long, log double").toArrow()
    return _ordered(got.column(0).to_numpy().view(U64), got.column(1).to_numpy())


def common_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Training words of a class of counts of at least least, in order, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                word, count = unpack(blob.as_py(), 2)
                keep = count_class(count) >= least
                yield pa.RecordBatch.from_arrays([pa.array(word[keep].view(np.int64)), pa.array(count[keep].view(np.int64))], ["key", "c"])

    got = counts.where(F.col("kind") == WORD).select("blob").mapInArrow(run, "key long, c long").toArrow()
    return _ordered(got.column(0).to_numpy().view(U64), got.column(1).to_numpy())


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked among sorted keys, and whether they stand there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return place, keys[place] == asked


class _Sums:
    """Known words, base score and score, added up by row."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, row: np.ndarray, known: np.ndarray, base: np.ndarray, log: np.ndarray) -> None:
        self.parts.append(_grouped(row, known, base, log))
        self.size += len(self.parts[-1][0])

    def take(self) -> tuple[np.ndarray, ...] | None:
        """All rows in order, with their sums."""
        if not self.parts:
            return None
        columns = _grouped(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.size = [], 0
        return columns


def asked_scores(counts: DataFrame, asked: DataFrame, short: Tables, alpha: float, floor: float) -> DataFrame:
    """(row, known, base, log): sums over a row's asked words and grams, which asked (kind, bucket, blob) packs with rows and times.

    A task's sums go on as blobs by a hash of the row, so that neither shuffle holds a record for each gram or text."""
    buckets = _buckets(counts)
    sent = counts.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = sent.value, _Sums()

        def score(kind: int, keys: np.ndarray, counts: np.ndarray, pairs: list) -> None:
            key, row, times = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(key)
            key, row, times = key[order], row[order], times[order].astype(np.int64)
            first = _starts(key)
            many = np.diff(np.append(first, len(key)))
            if kind == GRAM:
                log = np.repeat(tables.log10(key[first]), many)
                sums.add(row, np.zeros(len(row), np.int64), np.zeros(len(row)), log * times)
            else:
                place, hit = _found(keys, key[first])
                c = np.where(hit, counts[place] if len(counts) else 0, 0)
                sums.add(row, np.repeat(hit, many) * times, np.repeat(np.log10((c + alpha) / floor), many) * times, np.zeros(len(row)))

        for (kind, _), rows in _grouped_rows(batches):
            keys, own, pairs, size, built = np.zeros(0, U64), np.zeros(0, np.int64), [], 0, kind != GRAM
            for _, _, is_asked, blob in rows:
                if not is_asked:  # comes first
                    keys, own = unpack(blob, 2)
                    own = own.astype(np.int64)
                    continue
                if not built:
                    tables.put_long(keys, own)
                    built = True
                pairs.append(unpack(blob, 3))
                size += len(pairs[-1][0])
                if size > GATHERED:
                    score(kind, keys, own, pairs)
                    pairs, size = [], 0
            if pairs:
                score(kind, keys, own, pairs)
            if sums.size > GATHERED:
                yield from out(sums)
        yield from out(sums)

    def out(sums: _Sums) -> Iterator[pa.RecordBatch]:
        if (columns := sums.take()) is not None:
            row, known, base, log = columns
            deal = _dealt((C.mix(row) % U64(buckets)).astype(np.int64), row, known, base.view(U64), log.view(U64))
            for _, _, b, blob in _packed(0, ((b, pack(*x)) for b, x in deal)):
                yield pa.RecordBatch.from_arrays([b, blob], ["bucket", "blob"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for blob in batch.column(1):
                row, known, base, log = unpack(blob.as_py(), 4)
                sums.add(row, known.astype(np.int64), base.view(np.float64), log.view(np.float64))
                if sums.size > GATHERED:
                    sums.add(*sums.take())
        if (columns := sums.take()) is not None:
            for k in range(0, len(columns[0]), 100_000):
                row, *more = (c[k : k + 100_000] for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)), *map(pa.array, more)], ["row", "more_known", "more_base", "more_score"])

    rows = counts.where(F.col("kind") != TEXTS).select("kind", "bucket", F.lit(False).alias("asked"), "blob").union(asked.select("kind", "bucket", F.lit(True), "blob"))
    rows = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind", "bucket", "asked").mapInArrow(run, "bucket int, blob binary")
    return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(total, "row long, more_known long, more_base double, more_score double")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, depth: int = 6, alpha: float = 0.1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose id's crc32 modulo folds is held (and rows without an id) are scored only; all others are learned from too. score is the
    model's log10 probability of the lower-cased text and its end; bits_per_byte is the code length. base_score is that of single words and one
    end per text, with alpha added to counts. Words are told apart by a 64-bit hash. A null text is empty; repeated
    rows count and are scored each; an empty table gives an empty result; other columns aren't read. depth is at most 6.
    """
    if not NEAR <= depth <= 6:
        raise ValueError(f"depth must be from {NEAR} to 6")
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(C.fold("doc_id", folds) == held, F.lit(True))
    counts = C.stored(corpus_counts(texts.where(~held_out).select("text"), depth), "counts")
    totals = {r.kind: (r.n, r.c) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()}
    known, ends = totals.get(WORD, (0, 0)), totals.get(TEXTS, (0, 0))[1]
    total, distinct = known[1] + ends, known[0] + (ends > 0)
    floor = total + alpha * (distinct + 1)
    short = Tables.short(counts, depth)
    hot = (*common_grams(counts, short, least_class(counts, GRAM, HOT_GRAMS)), *common_words(counts, least_class(counts, WORD, HOT_WORDS)))
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    end_log = math.log10((ends + alpha) / floor)
    buckets = _buckets(docs)
    names = ["kind", "bucket", "row", "doc_id", "n_tokens", "n_known", "base", "score", "bytes", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, code_logs, keys, values = sent.value
        logs = np.log10((values + alpha) / floor)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        asked: dict[int, list] = {GRAM: [], WORD: []}
        deal, id_type = {GRAM: near_bucket, WORD: word_bucket}, None

        def blobs(kind: int, least: int = 0) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in asked[kind]) <= least:
                return
            key, of, times = (np.concatenate(x) for x in zip(*asked[kind], strict=True))
            asked[kind] = []
            order = np.argsort(key)
            key, of, times = key[order], of[order], times[order]
            for n, k, b, blob in _packed(kind, ((b, pack(*x)) for b, x in _dealt(deal[kind](key, buckets), key, of, times))):
                blank = [pa.nulls(n, t) for t in (pa.int64(), id_type, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([k, b, *blank, blob], names)

        for batch in batches:
            id_type = batch.column(0).type
            for i, j, raw, off in itertools.chain.from_iterable(_few(x) for x in C.text_chunks(batch.column(1), 1 << 20)):
                n, raw = j - i, C.LOWER[raw]
                code, of = grams(raw, off, depth)
                pair = code << U64(8) | of.astype(U64)  # at most 256 texts
                pair.sort()
                first = _starts(pair)
                times, pair = np.diff(np.append(first, len(pair))), pair[first]
                code, of = pair >> U64(8), (pair & U64(255)).astype(np.int64)
                first = _starts(code)
                place, hit = _found(codes, code[first])
                many = np.diff(np.append(first, len(code)))
                log = np.repeat(np.where(hit, code_logs[place], 0.0) if len(codes) else np.zeros(len(first)), many)
                score, far = np.bincount(of, log * times, n), ~np.repeat(hit, many)
                asked[GRAM].append((code[far], (row + of[far]).astype(U64), times[far]))
                start, end, doc = C.spans(raw, off)
                word = C.span_hashes(C.prefix_sums(raw), start, end)
                place, hit = _found(keys, word)
                base = np.bincount(doc[hit], logs[place[hit]], n) + end_log
                seen = np.bincount(doc[hit], minlength=n) + (ends > 0)
                asked[WORD].append((word[~hit], (row + doc[~hit]).astype(U64), np.ones((~hit).sum(), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, SCORED, np.int32)), pa.nulls(n, pa.int32()), pa.array(row + np.arange(n)), batch.column(0).slice(i, n), pa.array(np.bincount(doc, minlength=n) + 1), pa.array(seen), pa.array(base), pa.array(score), pa.array(np.diff(off)), pa.nulls(n, pa.binary())], names)
                row += n
                for k in asked:
                    yield from blobs(k, GATHERED)
        for k in asked:
            yield from blobs(k)

    every = C.stored(texts.mapInArrow(run, f"kind int, bucket int, row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, bytes long, blob binary"), "scored")
    more = asked_scores(counts, every.where(F.col("kind") != SCORED).select("kind", "bucket", "blob"), short, alpha, floor)
    out = every.where(F.col("kind") == SCORED).drop("kind", "bucket", "blob").join(more, "row", "left")
    zero = F.lit(0)
    score = F.col("score") + F.coalesce("more_score", zero)
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        score.alias("score"),
        (-score * math.log2(10) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _few(chunk: tuple, most: int = 256) -> Iterator[tuple]:
    """A chunk of texts in runs of at most so many."""
    i, j, raw, off = chunk
    for a in range(i, j, most):
        b = min(a + most, j)
        yield a, b, raw[off[a - i] : off[b - i]], off[a - i : b - i + 1] - off[a - i]
