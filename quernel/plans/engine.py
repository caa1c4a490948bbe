"""Indexing and hybrid search over a directory or a table of files."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, maxsim
from ..operators.bm25 import Index
from ..operators.chunking import chunk
from ..operators.encoder import HashEncoder, TokenEncoder
from ..operators.vector_store import VectorStore
from ..sources.directory import OWN, read_directory, scan_summary


#: Candidates up to which they are looked up by an IN filter.
LISTED = 2000


def hybrid(index: Index, chunks: DataFrame, vectors: VectorStore, query: str, matrix: np.ndarray, limit: int = 10, weight: float = 0.3) -> DataFrame:
    """(path, bm25_score, semantic_score, fusion_score): BM25's best limit * 10 chunks, reranked by late interaction and fused.

    chunks has (chunk_id, hash). The candidates, at most limit * 10 rows, are found once and come to the driver; up to LISTED of them
    are looked up by IN filters, which Parquet's statistics and Bloom filters answer, more by broadcast: neither large table is
    shuffled. Without vectors for any candidate the semantic side is empty.
    """
    spark = chunks.sparkSession
    found = spark.createDataFrame(index.search(query, 10 * limit).collect(), "chunk_id string, score double")
    bm25 = fusion.chunks_to_files(found)

    def looked_up(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
        if 10 * limit > LISTED:
            return table.join(F.broadcast(keys.select(column).distinct()), column)
        return table.where(F.col(column).isin([r[0] for r in keys.select(column).distinct().collect()]))

    asked = looked_up(chunks.select("chunk_id", "hash"), "chunk_id", found)
    asked = spark.createDataFrame(asked.collect(), "chunk_id string, hash string")
    rows = vectors.unpacked(looked_up(vectors.stored(), "hash", asked)).join(F.broadcast(asked), "hash").select("chunk_id", "embedding")
    semantic = fusion.chunks_to_files(maxsim.score(rows, matrix, "chunk_id"))
    semantic = spark.createDataFrame(semantic.collect(), "doc_id string, score double")
    fused = fusion.weighted(bm25, semantic, weight)
    out = fused.withColumnRenamed("score", "fusion_score").join(bm25.withColumnRenamed("score", "bm25_score"), "doc_id", "left").join(semantic.withColumnRenamed("score", "semantic_score"), "doc_id", "left")
    rounded = lambda c: F.round(c, 6).alias(c)
    return out.select(F.col("doc_id").alias("path"), rounded("bm25_score"), rounded("semantic_score"), rounded("fusion_score")).orderBy(F.desc("fusion_score"), "path").limit(limit)


def bm25_only(index: Index, query: str, limit: int = 10) -> DataFrame:
    files = fusion.chunks_to_files(index.search(query, 10 * limit))
    score = F.round("score", 6)
    return files.select(F.col("doc_id").alias("path"), score.alias("bm25_score"), F.lit(None).cast("double").alias("semantic_score"), score.alias("fusion_score")).orderBy(F.desc("fusion_score"), "path").limit(limit)


def text_lines(results: DataFrame) -> DataFrame:
    return results.select(F.format_string("%s: %.4f", "path", "fusion_score").alias("line"))


def json_rows(results: DataFrame) -> DataFrame:
    """One JSON object a row; the third field has the name that readers of the format expect."""
    named = F.struct("path", "bm25_score", F.col("semantic_score").alias("colbert_score"), "fusion_score")
    return results.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("json"))


@dataclass
class Engine:
    """An index kept in <root>/.quernel, or in `home`."""

    spark: SparkSession
    root: str
    home: str | None = None
    encoder: TokenEncoder = field(default_factory=HashEncoder)

    def __post_init__(self) -> None:
        self.home = self.home or os.path.join(self.root, OWN)
        self.store = VectorStore(self.spark, f"{self.home}/vectors", self.encoder.dim)

    def index(self, files: DataFrame | None = None, encode: bool = True) -> dict[str, int]:
        """Indexes files (path, content), by default those of root. Indexing again replaces the index and encodes new chunks only."""
        summary: dict[str, int] = {}
        if files is None:
            read = read_directory(self.spark, self.root).cache()
            summary = scan_summary(read).first().asDict()
            files = read.where("status = 'kept'").select("path", "content")
            if not summary["kept"]:
                return summary | {"chunks": 0, "cached": 0, "embedded": 0, "errors": 0}
        chunk(files).write.mode("overwrite").option("parquet.bloom.filter.enabled#chunk_id", "true").parquet(f"{self.home}/chunks")
        chunks = self.spark.read.parquet(f"{self.home}/chunks")
        Index.build(chunks).write(f"{self.home}/bm25")
        summary |= {"chunks": chunks.count(), "cached": self.store.present(chunks).count(), "embedded": 0, "errors": 0}
        if encode:
            fresh = self.store.missing(chunks.select("hash", "formatted")).dropDuplicates(["hash"])
            self.encoder.encode_table(fresh).write.mode("overwrite").parquet(f"{self.home}/encoded")
            done = self.spark.read.parquet(f"{self.home}/encoded")
            self.store.insert(done.where("error is null"))
            ok, all_ = done.where("error is null").count(), done.count()
            summary |= {"embedded": ok, "errors": all_ - ok}
        return summary

    def search(self, query: str, limit: int = 10, bm25: bool = False) -> DataFrame:
        try:
            index = Index.read(self.spark, f"{self.home}/bm25")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                raise FileNotFoundError(f"no index in {self.home}; run: python -m quernel index {self.root}") from e
            raise
        if bm25:
            return bm25_only(index, query, limit)
        if self.store.is_empty():
            warnings.warn("no vectors are stored; searching by BM25 only", stacklevel=2)
            return bm25_only(index, query, limit)
        return hybrid(index, self.spark.read.parquet(f"{self.home}/chunks"), self.store, query, self.encoder.encode(query, "query"), limit)
