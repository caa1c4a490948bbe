"""Line-aligned overlapping chunks of texts, by sizes in UTF-8 bytes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import spread

#: The characters of T.SPACE.
_BLANK = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Bytes of text whose chunks a worker gathers before it hands them on; one longer text is taken whole.
PART_BYTES = 1 << 20


def spans(text: str | None, size: int = 1500, overlap: int = 200) -> Iterator[tuple[str, int, int, int]]:
    """(content, start byte, end byte, first line) of each chunk that isn't blank; the content has no blank end.

    Lines are packed while the bytes with their line ends stay within size, at least one line each time; the next
    chunk goes back over whole lines within overlap, but on by one line at least. Line ends are \\n or \\r\\n and count as they stand.
    """
    if not text or not (kept := text.rstrip(_BLANK)):
        return
    whole = len(text.encode())
    if whole <= size:
        yield kept, 0, whole, 0
        return
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    at = [0, *accumulate(len(x.encode()) + 1 for x in lines)]
    n, s = len(lines), 0
    while True:
        e = max(s + 1, bisect_right(at, at[s] + size) - 1)
        content = "\n".join(lines[s:e]).rstrip(_BLANK)
        if content:
            yield content, at[s], min(at[e], whole), s
        if e >= n:
            return
        back = bisect_left(at, at[e] - overlap)
        s = back if back > s else s + 1


_COLUMNS = {"path": pa.string(), "chunk_idx": pa.int32(), "content": pa.string(), "start_byte": pa.int64(), "end_byte": pa.int64(), "start_line": pa.int32()}


def chunk_rows(batches: Iterator[pa.RecordBatch], size: int = 1500, overlap: int = 200) -> Iterator[pa.RecordBatch]:
    """Chunks of (path, text) batches. Texts are taken one by one and their chunks handed on by PART_BYTES, so a worker holds its input batch and little more."""
    for batch in batches:
        rows, held = [], 0
        for i, (path, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
            path, text = path.as_py(), text.as_py()
            rows += [(path, k, *c) for k, c in enumerate(spans(text, size, overlap))]
            held += len(text or "")
            if rows and (held >= PART_BYTES or i == batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _COLUMNS.values(), strict=True)], list(_COLUMNS))
                rows, held = [], 0


def chunk(files: DataFrame, path_col: str = "path", text_col: str = "content", size: int = 1500, overlap: int = 200) -> DataFrame:
    """(path, chunk_idx, chunk_id, content, start_byte, end_byte, start_line, formatted, hash) of files; no shuffle, unless their partitions are fewer than the cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return chunk_rows(batches, size, overlap)

    rows = spread(files.select(F.col(path_col).alias("path"), F.col(text_col).alias("content"))).mapInArrow(run, "path string, chunk_idx int, content string, start_byte long, end_byte long, start_line int")
    name = T.chunk_id(F.col("path"), F.col("chunk_idx"))
    line = T.formatted(F.col("chunk_id"), F.col("content"))
    return rows.withColumn("chunk_id", name).withColumn("formatted", line).withColumn("hash", T.content_hash(F.col("formatted")))


#: Texts of a batch at most, and estimated tokens that close one.
BATCH_ROWS, BATCH_TOKENS = 64, 8192


class Batcher:
    """Deals rows to greedy batches in their order: one is closed at BATCH_ROWS rows or where a row would lead beyond BATCH_TOKENS; it has one row at least."""

    def __init__(self, limit: int = BATCH_TOKENS, most: int = BATCH_ROWS) -> None:
        self.limit, self.most, self.batch, self.count, self.total = limit, most, 0, 0, 0

    def next(self, tokens: int) -> int:
        if self.count and (self.count >= self.most or self.total + tokens > self.limit):
            self.batch, self.count, self.total = self.batch + 1, 0, 0
        self.count, self.total = self.count + 1, self.total + tokens
        return self.batch


def batch_rows(batches: Iterator[pa.RecordBatch], limit: int = BATCH_TOKENS, most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches with a column batch for their tokens; rows come sorted by group, and a group goes on from one batch to the next."""
    now, dealer = None, Batcher(limit, most)
    for batch in batches:
        out = []
        for g, t in zip(batch["group"].to_pylist(), batch["tokens"].to_pylist(), strict=True):
            if g != now:
                now, dealer = g, Batcher(limit, most)
            out.append(dealer.next(t))
        yield batch.drop_columns("tokens").append_column("batch", pa.array(out, pa.int32()))


def token_batches(chunks: DataFrame, group: Column, limit: int = BATCH_TOKENS, most: int = BATCH_ROWS) -> DataFrame:
    """(group, path, chunk_idx, batch) of chunks (path, chunk_idx, tokens): greedy batches within each group, in order of path and index.

    A group's rows come sorted to one task, which passes them through and holds the open batch's sums only, so a group may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batch_rows(batches, limit, most)

    rows = chunks.select(group.cast("string").alias("group"), "path", "chunk_idx", F.col("tokens").cast("long").alias("tokens"))
    rows = rows.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group").sortWithinPartitions("group", "path", "chunk_idx")
    return rows.mapInArrow(run, "group string, path string, chunk_idx int, batch int")
