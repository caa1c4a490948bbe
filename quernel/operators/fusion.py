"""Combining ranked lists: rollup of chunks to files, normalisation, weighted and reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import stored

RRF_K = 60
#: A range up to this (the single-precision epsilon) counts as none.
EPSILON = 1.1920929e-7


def chunks_to_files(scores: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(doc_id, score): the best score of each file's chunks; an id that is no chunk id stands for itself."""
    path = F.coalesce(T.parse_chunk_id(F.col(id_col))["path"], F.col(id_col))
    return scores.groupBy(path.alias("doc_id")).agg(F.max("score").alias("score"))


def minmax(scores: DataFrame) -> DataFrame:
    """(doc_id, score) with scores from 0 to 1; all 1 where they don't differ. The one row of bounds is broadcast."""
    ends = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    width = F.col("high") - F.col("low")
    return scores.crossJoin(F.broadcast(ends)).select("doc_id", F.when(width > EPSILON, (F.col("score") - F.col("low")) / width).otherwise(1.0).alias("score"))


def weighted(bm25: DataFrame, semantic: DataFrame, weight: float = 0.3) -> DataFrame:
    """(doc_id, score): weight * bm25 + (1 - weight) * semantic, each normalised, an absent one 0."""
    parts = minmax(bm25).select("doc_id", (weight * F.col("score")).alias("score")).unionByName(minmax(semantic).select("doc_id", ((1 - weight) * F.col("score")).alias("score")))
    return parts.groupBy("doc_id").agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """scores with rank: the place by falling score, ties by id, over the whole list, however long.

    The list is written to range partitions of (score, id) and each is numbered by itself, offset by the counted rows of those before; one
    number per partition reaches the driver. Nothing but a partition's sort holds more than a row."""
    spark = scores.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scores.select("doc_id", "score").repartitionByRange(parts, F.desc("score"), F.asc("doc_id")).sortWithinPartitions(F.desc("score"), F.asc("doc_id"))
    rows = stored(rows.withColumn("part", F.spark_partition_id()), "ranked")
    counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    before, total = [], 0
    for k in sorted(counts):
        before.append(F.when(F.col("part") == k, F.lit(total)))
        total += counts[k]
    order = Window.partitionBy("part").orderBy(F.desc("score"), "doc_id")
    return rows.select("doc_id", "score", (F.row_number().over(order) + F.coalesce(*before, F.lit(0))).cast("long").alias("rank"))


def reciprocal_rank(*rankings: DataFrame) -> DataFrame:
    """(doc_id, score): the sum of 1 / (60 + rank) over any number of (doc_id, score) lists, ties by id."""
    parts = [ranked(r).select("doc_id", (F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))
