"""Token matrices by content hash: (hash, num_tokens, embedding) as a Parquet table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from .encoder import TokenEncoder

SCHEMA = "hash string, num_tokens int, embedding array<array<float>>"


#: What a store with an encoder holds.
PACKED = "hash string, num_tokens int, packed binary"
#: Repeated hashes up to which they are broadcast.
FEW = 100_000


class VectorStore:
    """With an encoder, matrices are held as it packs them, else as arrays of single precision."""

    def __init__(self, spark: SparkSession, path: str, dim: int = 128, encoder: TokenEncoder | None = None) -> None:
        self.spark, self.path, self.dim, self.encoder = spark, path, dim, encoder

    def stored(self) -> DataFrame:
        """All entries as they are held; a store that was never written is empty, a path that holds another format a ValueError."""
        schema = PACKED if self.encoder else SCHEMA
        try:
            have = {k: v for k, v in self.spark.read.parquet(self.path).dtypes}
            if any(have.get(k) != v for k, v in self.spark.createDataFrame([], schema).dtypes):
                raise ValueError(f"{self.path} is no vector store: {have}")
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def unpacked(self, entries: DataFrame) -> DataFrame:
        """(hash, num_tokens, embedding) of stored entries; filters by hash go before it, so that they reach the files."""
        if not self.encoder:
            return entries.select("hash", "num_tokens", "embedding")
        encoder = self.encoder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    part = batch.slice(i, 64)
                    found = [encoder.unpack(p) for p in part.column(2).to_pylist()]
                    bound = np.concatenate(([0], np.cumsum([len(m) for m in found])))
                    inner = pa.ListArray.from_arrays(pa.array(np.arange(bound[-1] + 1) * encoder.dim, pa.int32()), pa.array(np.concatenate(found).astype(np.float32).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(bound, pa.int32()), inner)], ["hash", "num_tokens", "embedding"])

        return entries.select("hash", "num_tokens", "packed").mapInArrow(run, SCHEMA)

    def table(self) -> DataFrame:
        """All entries with their matrices."""
        return self.unpacked(self.stored())

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose hash has no entry."""
        return rows.join(self.stored().select("hash"), "hash", "left_anti")

    def present(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.stored().select("hash"), "hash", "left_semi")

    def encode(self, chunks: DataFrame) -> None:
        """Adds the matrices of all chunks (hash, formatted) whose hash is new, one of each. Repeated and known hashes are
        taken out before encoding: matrices are made and written in one task and never shuffled."""
        rows = chunks.select("hash", "formatted")
        again = stored(rows.groupBy("hash").agg(F.count("*").alias("many")).where("many > 1").select("hash"), "repeated")
        if n := again.count():
            keys = F.broadcast(again) if n <= FEW else again
            rows = rows.join(keys, "hash", "left_anti").unionByName(rows.join(keys, "hash", "left_semi").dropDuplicates(["hash"]))
        if not self.is_empty():
            rows = self.missing(rows)
        packed = self.encoder.packed_table(rows).write.mode("append").option("parquet.bloom.filter.enabled#hash", "true")
        packed.option("compression", "zstd").option("parquet.page.size", str(8 << 20)).parquet(self.path)  # a word's row repeats within a page

    def insert(self, vectors: DataFrame) -> None:
        """Adds the entries whose hash is new, one of each; a row of another width is an error."""
        if self.encoder:
            raise ValueError("a store with an encoder takes texts, by encode")
        wrong = F.exists("embedding", lambda r: F.size(r) != self.dim)
        checked = F.when(wrong, F.raise_error(F.lit(f"expected vectors of {self.dim} components"))).otherwise(F.col("embedding"))
        fresh = self.missing(vectors.dropDuplicates(["hash"])).select("hash", "num_tokens", checked.cast("array<array<float>>").alias("embedding"))
        fresh.write.mode("append").option("parquet.bloom.filter.enabled#hash", "true").parquet(self.path)

    def get(self, hash_: str) -> np.ndarray:
        """The matrix of one entry; a hash without an entry is a KeyError, a damaged entry a ValueError."""
        row = self.unpacked(self.stored().where(F.col("hash") == hash_)).first()
        if row is None:
            raise KeyError(hash_)
        found = np.array(row["embedding"], np.float32).reshape(len(row["embedding"]), -1)
        if len(found) != row["num_tokens"] or len(found) and found.shape[1] != self.dim:
            raise ValueError(f"entry {hash_} has {found.shape}, not {row['num_tokens']} x {self.dim}")
        return found

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Entries for (ordinal, hash), with the ordinal; duplicates stay, missing ones are left out."""
        return asked.join(self.table(), "hash").select("ordinal", "hash", "num_tokens", "embedding")

    def __len__(self) -> int:
        return self.stored().count()

    def is_empty(self) -> bool:
        return self.stored().isEmpty()

    def hashes(self) -> DataFrame:
        return self.stored().select("hash")
