"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, ctw, minhash, mixing, permutation, pigeonhole, quality, secrets, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, domain): the language of up to 4000 documents that have a row in labels; at most so many ids are broadcast."""
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(4000)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.rates(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), TARGETS)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.digests(chat.format_chats(turns.union(more)))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    values = F.array_join(F.transform("findings", lambda f: F.concat(f["at"].cast("string"), F.lit(" "), f["value"], F.lit("\n"))), "")
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), F.sha2(values.cast("binary"), 256).alias("findings_sha256"), F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"))


#: Wanted shares of tokens by language.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_toxicity, op3_embedding_near_dedup, op4_byte_bpe, op5_quality, op6_lm_scoring, op7_mixing, op8_nearest_neighbours, op9_chat_formatting, op10_secret_scans)
}

#: DuckDB SQL for those that SQL expresses: all pairs that share a shingle, all pairs of vectors, closed links.
ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE lists AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM lists),
        held AS (SELECT doc_id, hash(unnest(s)) AS s, len(s) AS n FROM shingles),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM held a JOIN held b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        first AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
        FROM shingles LEFT JOIN first ON doc_id = x""",
    "op3_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
            AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        first AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
        many AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id <= coalesce(y, vec_id) AS kept
        FROM embeddings LEFT JOIN first ON vec_id = first.x LEFT JOIN many ON vec_id = many.x""",
    "op9_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(15 + 2 * length(role) - length(regexp_replace(role, '[\\#<:]', '', 'g'))
                + 2 * length(text) - length(regexp_replace(text, '[\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
}
