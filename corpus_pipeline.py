"""The training-data pipeline: documents that the quality classifier accepts, one of each near-duplicate group, without
secrets, mixed to target weights, as token digests. Each stage's rows are written as Parquet and read again.

Every stage takes null ids and texts, empty texts, repeated rows, empty tables and further columns: a null or empty text is
judged by the statistics of no text, is nobody's duplicate, holds no secret, counts no token and has no token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import bpe, minhash, mixing, quality, secrets
from quernel.llm import common as C
from quernel.llm.queries import TARGETS, TOKENIZER, labelled_languages, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    score = C.fresh(docs, "quality_score")
    scored = quality.with_quality(docs, table(spark, sf_dir, "labels"), score_col=score)
    return scored.where(F.col(score) >= 0.7).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more. The dropped ids are joined, broadcast only within a counted bound.

    A row without an id stands behind those with one (below 2^62), by a hash of its text. Of rows that share id and text
    one stays; rows that share an id but not the text stay or go together."""
    id_, digest, key = (C.fresh(docs, x) for x in ("row_id", "digest", "row_key"))
    own = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    rows = docs.withColumn(id_, F.coalesce("doc_id", own))
    dropped = minhash.near_duplicates(rows, id_col=id_, width=5, percent=80).where("NOT kept").select(F.col("doc_id").alias(id_)).distinct()
    dropped = C.stored(dropped, "dropped")
    rows = rows.withColumn(digest, F.coalesce(F.sha2("text", 256), F.lit(""))).join(C.small(dropped, dropped.count()), id_, "left_anti")
    rows = rows.withColumn(key, F.xxhash64(id_, digest))
    # only rows that occur again are shuffled with their texts
    again = C.stored(rows.groupBy(key).count().where("count > 1").select(key), "again")
    n = again.count()
    if not n:
        return rows.select(docs.columns)
    once = rows.join(C.small(again, n), key, "left_anti")
    more = rows.join(C.small(again, n), key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.select(docs.columns).union(more.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in the text; n_chars follows."""
    found = secrets.scan(docs)
    return found.select(*[F.col("redacted").alias(c) if c == "text" else F.length("redacted").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its own rate says. A rate's fraction is drawn by the hash of the id, so that rows that share an
    id share the draw; rows without an id draw by their text."""
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    id_ = C.fresh(docs, "row_id")
    rates = mixing.rates(docs.withColumn(id_, F.coalesce("doc_id", F.xxhash64("text"))), labelled, TARGETS, id_col=id_, carry=True)
    return rates.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, TOKENIZER, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", accept),
    ("MinHash near-dedup", deduplicate),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokenize),
]

#: SQL expresses neither the classifiers nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, others = table(spark, sf_dir, "documents"), set(C.tables())
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        C.release(spark, [t for t in C.tables()[:-1] if t not in others])  # what led to the stage's rows; these stay
    return docs
