"""Named queries over the test tables, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, maxsim
from ..operators.bm25 import Index, tokens
from ..operators.chunking import chunk, token_batches
from ..operators.encoder import HashEncoder
from ..operators.query_parser import parse
from ..operators.vector_store import VectorStore
from ..sources.directory import MAX_BYTES, documents
from ..sources.shared import folder, stored
from . import engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# SQL fragments
_FILES = "files AS (SELECT source || '/' || doc_id AS path, text AS content FROM documents)"
_TOKENS = r"regexp_extract_all(lower(regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[\p{L}\p{N}]+')"
_POSTINGS = f"""
    tok AS (SELECT d, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT source || '/' || doc_id AS d, {_TOKENS} AS t FROM documents)),
    kept AS (SELECT * FROM tok WHERE strlen(term) < 40),
    post AS (SELECT d, term, count(*) AS tf FROM kept GROUP BY d, term),
    len AS (SELECT d, count(*) AS dl FROM kept GROUP BY d),
    corp AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM kept)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    w AS (SELECT d, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
          FROM post JOIN len USING (d) JOIN df USING (term) CROSS JOIN corp)"""
_CHUNKS = r"""
    spaced AS (SELECT path, content, regexp_replace(content, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g') = '' AS blank FROM files),
    big AS (SELECT path, content, string_split(content, chr(10)) AS parts FROM spaced WHERE NOT blank AND strlen(content) > 1500),
    lines AS (SELECT path, content, CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts)-1] ELSE parts END AS parts FROM big),
    flat AS (SELECT path, i, strlen(parts[i]) + 1 AS size FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM lines)),
    sums AS (SELECT path, i, sum(size) OVER (PARTITION BY path ORDER BY i) AS upto FROM flat),
    p AS (SELECT path, list_prepend(0, list(upto::BIGINT ORDER BY i)) AS ofs, max(i) AS n FROM sums GROUP BY path),
    walk(path, ofs, n, s, e) AS (
        SELECT path, ofs, n, 0, greatest(1, len(list_filter(ofs, lambda x: x <= 1500)) - 1) FROM p
        UNION ALL
        SELECT path, ofs, n, nxt, greatest(nxt + 1, len(list_filter(ofs, lambda x: x <= ofs[nxt + 1] + 1500)) - 1)
        FROM (SELECT path, ofs, n, CASE WHEN b > s THEN b ELSE s + 1 END AS nxt
              FROM (SELECT path, ofs, n, s, e, len(list_filter(ofs, lambda x: x < ofs[e + 1] - 200)) AS b FROM walk WHERE e < n))),
    cut AS (SELECT w.path, s AS start_line, ofs[s + 1] AS start_byte, least(ofs[e + 1], strlen(content)) AS end_byte,
                array_to_string(parts[s + 1:e], chr(10)) AS body FROM walk w JOIN lines l USING (path)),
    whole AS (SELECT path, start_line::INT AS start_line, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, body FROM cut
        UNION ALL SELECT path, 0, 0, strlen(content), content FROM spaced WHERE NOT blank AND strlen(content) <= 1500)"""
_TRIMMED = r"regexp_replace(body, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '')"
_NAMED = f"named AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start_line) - 1)::INT AS chunk_idx, start_byte, end_byte, start_line, {_TRIMMED} AS content FROM whole WHERE {_TRIMMED} <> '')"
_FORMATTED = "form AS (SELECT *, path || '#chunk' || chunk_idx AS chunk_id, '// ' || path || '#chunk' || chunk_idx || chr(10) || content AS formatted FROM named)"


_CHUNK_POSTINGS = _POSTINGS.replace("SELECT source || '/' || doc_id AS d, ", "SELECT chunk_id AS d, ").replace("(text,", "(formatted,").replace("FROM documents", "FROM form")
_OVER_CHUNKS = f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED}, {_FORMATTED}, {_CHUNK_POSTINGS}"


def _best_files(*words: str) -> str:
    """The best 100 chunks for the words, and the best score of each file."""
    terms = ", ".join(f"'{w}'" for w in words)
    return f"""
    best AS (SELECT d, round(sum(s), 9) AS s FROM w WHERE term IN ({terms}) GROUP BY d ORDER BY 2 DESC, 1 LIMIT 100),
    lexical AS (SELECT regexp_replace(d, '#chunk[0-9]+$', '') AS path, max(s) AS s FROM best GROUP BY 1)"""


def _fused_files(*words: str) -> str:
    """Hybrid search by hash vectors of 32 components (SHA-256 bytes less 127.5, of length 1), single precision in documents."""
    names = ", ".join(f"'{n}'" for n in ["[CLS]", "[250002]", *words])
    return f"""{_best_files(*words)},
    listed AS (SELECT chunk_id AS d, {_TOKENS.replace("(text,", "(formatted,")}[1:126] AS t FROM form WHERE chunk_id IN (SELECT d FROM best)),
    held AS (SELECT DISTINCT d, unnest(list_concat(['[CLS]', '[250003]'], t)) AS name FROM listed),
    hashed AS (SELECT name, sha256('0:' || name) AS h FROM (SELECT name FROM held UNION SELECT unnest([{names}]))),
    raw AS (SELECT name, list_transform(range(32), lambda i: (strpos('0123456789abcdef', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 * i + 2, 1)) - 128.5::DOUBLE) AS v FROM hashed),
    vec AS (SELECT name, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM raw),
    near AS (SELECT d, q.name, max(list_inner_product(q.v, list_transform(e.v, lambda x: x::FLOAT::DOUBLE))) AS s FROM held JOIN vec e USING (name) CROSS JOIN (SELECT * FROM vec WHERE name IN ({names})) q GROUP BY 1, 2),
    semantic AS (SELECT regexp_replace(d, '#chunk[0-9]+$', '') AS path, max(s) AS s FROM (SELECT d, sum(s) AS s FROM near GROUP BY d) GROUP BY 1),
    nl AS (SELECT path, s, CASE WHEN max(s) OVER () - min(s) OVER () > 1.1920929e-7 THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END AS n FROM lexical),
    ns AS (SELECT path, s, CASE WHEN max(s) OVER () - min(s) OVER () > 1.1920929e-7 THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1 END AS n FROM semantic),
    found AS (SELECT path, round(nl.s, 6) AS bm25_score, round(ns.s, 6) AS semantic_score, round(0.3::DOUBLE * coalesce(nl.n, 0) + 0.7::DOUBLE * coalesce(ns.n, 0), 6) AS fusion_score
        FROM nl FULL JOIN ns USING (path) ORDER BY fusion_score DESC, path LIMIT 10)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(documents(spark, sf))


def _plain(spark: SparkSession, sf: str) -> Index:
    """An unstemmed index of whole documents, which SQL can express; written and read."""
    return _written(Index.build(documents(spark, sf), "path", "content", stemmed=False))


def _written(index: Index) -> Index:
    spark = index.postings.sparkSession
    top = folder(spark, "bm25")
    index.write(top)
    return Index.read(spark, top)


def _stemmed(spark: SparkSession, sf: str, stemmed: bool = True) -> tuple[Index, DataFrame]:
    """Chunks and their index, written and read as an Engine does."""
    chunks = stored(_chunks(spark, sf).select("chunk_id", "formatted", "hash"), "chunks")
    return _written(Index.build(chunks, stemmed=stemmed)), chunks


def _six(df: DataFrame, column: str = "score") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@query(f"SELECT count(*) FILTER (strlen(text) <= {MAX_BYTES}) AS kept, count(*) FILTER (strlen(text) > {MAX_BYTES}) AS skipped_large, 0 AS skipped_binary FROM documents")
def scan_filter_summary(spark: SparkSession, sf: str) -> DataFrame:
    files = documents(spark, sf).withColumn("bytes", F.col("content").cast("binary"))
    large = F.octet_length("content") > MAX_BYTES
    valid = F.is_valid_utf8(F.col("bytes").cast("string"))
    return files.agg(F.count_if(~large & valid).alias("kept"), F.count_if(large).alias("skipped_large"), F.count_if(~large & ~valid).alias("skipped_binary"))


@query("SELECT 'root/' || source || '/' || doc_id AS full, source || '/' || doc_id AS path FROM documents")
def relative_path(spark: SparkSession, sf: str) -> DataFrame:
    full = F.concat(F.lit("root/"), "path")
    return documents(spark, sf).select(full.alias("full"), F.regexp_replace(full, "^root/", "").alias("path"))


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED} SELECT path, chunk_idx, start_byte, end_byte, start_line FROM named")
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("path", "chunk_idx", "start_byte", "end_byte", "start_line")


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED} SELECT path, count(*) AS chunks FROM named GROUP BY path")
def chunk_counts_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).groupBy("path").agg(F.count("*").alias("chunks"))


@query(f"WITH {_FILES}, named AS (SELECT path, {_TRIMMED.replace('body', 'content')} AS content, strlen(content)::BIGINT AS end_byte FROM files WHERE strlen(content) <= 1500) SELECT path, content, end_byte FROM named WHERE content <> ''")
def chunk_small_docs(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(documents(spark, sf).where(F.octet_length("content") <= 1500)).select("path", "content", "end_byte")


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED}, {_FORMATTED} SELECT chunk_id, path, chunk_idx FROM form")
def chunk_id_format(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "path", "chunk_idx")


@query("""SELECT id, CASE WHEN n IS NOT NULL THEN regexp_extract(id, '(?s)^(.*)#chunk\\+?([0-9]+)$', 1) END AS path, n FROM (
    SELECT id, try_cast(regexp_extract(id, '(?s)^(.*)#chunk\\+?([0-9]+)$', 2) AS BIGINT) AS n FROM (
    SELECT source || CASE doc_id % 4 WHEN 0 THEN '#chunk' || doc_id WHEN 1 THEN '#chunkx' WHEN 2 THEN '' ELSE '#chunk1#chunk+' || doc_id END AS id FROM documents))""".replace("\\\\", "\\"))
def chunk_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    end = F.when(k == 0, F.concat(F.lit("#chunk"), n)).when(k == 1, "#chunkx").when(k == 2, "").otherwise(F.concat(F.lit("#chunk1#chunk+"), n))
    ids = docs.select(F.concat("source", end).alias("id"))
    got = T.parse_chunk_id(F.col("id"))
    return ids.select("id", got["path"].alias("path"), got["n"].alias("n"))


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED}, {_FORMATTED} SELECT chunk_id, formatted, sha256(formatted) AS hash FROM form")
def format_and_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", "formatted", "hash")


def _cache_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = documents(spark, sf).select("path", T.content_hash(F.col("content")).alias("hash"))
    return rows, rows.where(F.substring("hash", 1, 1).isin(list("01234567"))).select("hash").distinct()


@query(f"WITH {_FILES} SELECT path, sha256(content) AS hash FROM files WHERE sha256(content)[1] NOT IN ('0','1','2','3','4','5','6','7')")
def cache_miss_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _cache_parts(spark, sf)
    return rows.join(stored, "hash", "left_anti").select("path", "hash")


@query(f"WITH {_FILES} SELECT path, sha256(content) AS hash FROM files WHERE sha256(content)[1] IN ('0','1','2','3','4','5','6','7')")
def cache_hit_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    rows, stored = _cache_parts(spark, sf)
    return rows.join(stored, "hash", "left_semi").select("path", "hash")


@query(f"WITH {_FILES}, s AS (SELECT DISTINCT sha256(content) AS hash FROM files WHERE sha256(content)[1] IN ('0','1','2','3','4','5','6','7')) SELECT doc_id AS ordinal, hash FROM documents JOIN s ON hash = sha256(text)")
def batch_lookup_ordered(spark: SparkSession, sf: str) -> DataFrame:
    _, stored = _cache_parts(spark, sf)
    asked = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ordinal"), T.content_hash(F.col("text")).alias("hash"))
    return asked.join(stored, "hash").select("ordinal", "hash")


def _store(spark: SparkSession, sf: str) -> VectorStore:
    """A store into which the documents went twice."""
    store = VectorStore(spark, folder(spark, "store"), 2)
    row = F.array(F.array(F.octet_length("content").cast("float"), F.lit(1.0).cast("float")))
    entries = documents(spark, sf).select(T.content_hash(F.col("content")).alias("hash"), F.lit(1).alias("num_tokens"), row.alias("embedding"))
    store.insert(entries.where(F.substring("hash", 1, 1) < "8"))
    store.insert(entries)
    return store


@query("SELECT DISTINCT sha256(text) AS hash, 1 AS num_tokens, strlen(text)::DOUBLE AS first_component FROM documents")
def store_upsert_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf).table().select("hash", "num_tokens", F.col("embedding")[0][0].cast("double").alias("first_component"))


@query("SELECT count(DISTINCT sha256(text)) AS entries, false AS is_empty, count(DISTINCT sha256(text)) AS hashes FROM documents")
def store_metadata(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark, sf)
    return store.table().agg(F.count("*").alias("entries"), (F.count("*") == 0).alias("is_empty"), F.countDistinct("hash").alias("hashes"))


_BATCHES = """
    g AS (SELECT substr(md5(path), 1, 2) AS grp, path, chunk_idx, strlen(formatted) // 4 AS tokens FROM form),
    o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY path, chunk_idx) AS i, sum(tokens) OVER (PARTITION BY grp ORDER BY path, chunk_idx) AS upto FROM g),
    q AS (SELECT grp, list_prepend(0, list(upto::BIGINT ORDER BY i)) AS ofs, max(i) AS m FROM o GROUP BY grp),
    step(grp, ofs, m, s, e, batch) AS (
        SELECT grp, ofs, m, 0, least(m, 64, greatest(1, len(list_filter(ofs, lambda x: x <= 8192)) - 1)), 0 FROM q
        UNION ALL
        SELECT grp, ofs, m, e, least(m, e + 64, greatest(e + 1, len(list_filter(ofs, lambda x: x <= ofs[e + 1] + 8192)) - 1)), batch + 1 FROM step WHERE e < m)"""


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED}, {_FORMATTED}, {_BATCHES} SELECT o.grp AS \"group\", path, chunk_idx, batch FROM o JOIN step ON o.grp = step.grp AND i > s AND i <= e")
def est_token_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy batches within groups of paths of like hash, so that batching runs in parallel."""
    rows = _chunks(spark, sf).select("path", "chunk_idx", T.estimated_tokens(F.col("formatted")).alias("tokens"))
    return token_batches(rows, F.substring(F.md5("path"), 1, 2))


@query(f"SELECT doc_id, list_filter({_TOKENS}, lambda x: strlen(x) < 40)::VARCHAR AS tokens FROM documents".replace("::VARCHAR AS tokens", " AS t").replace("SELECT doc_id", "SELECT doc_id, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id", 1) + ")")
def tokenize_code(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.array_join(F.filter(T.code_tokens(F.col("text")), lambda x: F.octet_length(x) < T.LONG_TOKEN), " ").alias("tokens"))


@query(r"SELECT doc_id, regexp_replace(text, '(\p{Ll})(\p{Lu})', '\1 \2', 'g') AS parts FROM documents")
def camel_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace("text", r"(\p{Ll})(\p{Lu})", "$1 $2").alias("parts"))


@query(f"WITH {_POSTINGS} SELECT d AS chunk_id, pos::INT AS pos, term FROM kept")
def token_positions(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(documents(spark, sf), "path", "content")


@query(f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term")
def vocabulary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return Index.build(documents(spark, sf), "path", "content", stemmed=False).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_POSTINGS} SELECT d AS chunk_id, dl FROM len")
def doc_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(documents(spark, sf), "path", "content").groupBy("chunk_id").agg(F.count("*").alias("dl"))


@query()
def stem_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.stemmer import stem_words

    words = documents(spark, sf).select(F.explode(T.code_tokens(F.col("content"))).alias("word")).distinct()
    return words.select("word", stem_words("word").alias("stem"))


@query(f"WITH {_POSTINGS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN corp")
def bm25_idf(spark: SparkSession, sf: str) -> DataFrame:
    index = _plain(spark, sf)
    rows = index.terms.crossJoin(F.broadcast(index.corpus))
    return rows.select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def _searched(name: str, text: str, sql: str) -> None:
    """A query of all matches, without limit."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _six(_plain(spark, sf).matches(parse(text)))

    run.__name__ = name
    query(f"WITH {_POSTINGS} {sql}")(run)


_IN = "SELECT d AS chunk_id, round(sum(s), 6) AS score FROM w WHERE term IN ({}) GROUP BY d"
_searched("bm25_single_term", "the", _IN.format("'the'"))
_searched("bm25_multi_term", "the of tion under ing", _IN.format("'the','of','tion','under','ing'"))
_searched("bm25_must_not", "+the of -ing", "SELECT d AS chunk_id, round(sum(s), 6) AS score FROM w WHERE term IN ('the','of') AND d IN (SELECT d FROM w WHERE term = 'the') AND d NOT IN (SELECT d FROM w WHERE term = 'ing') GROUP BY d")
_searched("bm25_and", "the AND ing", "SELECT d AS chunk_id, round(sum(s), 6) AS score FROM w WHERE term IN ('the','ing') GROUP BY d HAVING count(*) = 2")
_searched("bm25_boost", "the^2.5 of", "SELECT d AS chunk_id, round(sum(CASE term WHEN 'the' THEN 2.5 ELSE 1 END * s), 6) AS score FROM w WHERE term IN ('the','of') GROUP BY d")
_PHRASE = """, hit AS (SELECT a.d, count(*) AS tf FROM kept a JOIN kept b ON a.d = b.d AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.d)
    SELECT d AS chunk_id, round((SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) FROM df, corp WHERE term IN ('of','the')) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM hit JOIN len USING (d) CROSS JOIN corp"""
_searched("bm25_phrase", '"of the"', _PHRASE)
_searched("bm25_camel_phrase", "ofThe", _PHRASE)


@query()
def bm25_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _stemmed(spark, sf)
    return _six(index.search("things running", 100))


@query(f"{_OVER_CHUNKS}, {_best_files('the', 'of', 'ing')} SELECT path, round(s, 6) AS score FROM lexical ORDER BY 2 DESC, 1 LIMIT 10")
def bm25_files(spark: SparkSession, sf: str) -> DataFrame:
    found = engine.bm25_only(_written(Index.build(_chunks(spark, sf), stemmed=False)), "the of ing", 10)
    return found.select("path", F.col("fusion_score").alias("score"))


@query(f"WITH {_POSTINGS}, q AS (SELECT item_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark), r AS (SELECT item_id, d, round(sum(s), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2) SELECT item_id, d AS chunk_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, d)::INT AS rank FROM r QUALIFY rank <= 5")
def bm25_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item as a query."""
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(F.array_distinct(T.code_tokens(F.col("text")))).alias("term"))
    return _plain(spark, sf).best(asked, 5)


# vectors: ten rows of embeddings make a pseudo-document
_DOC = "e AS (SELECT vec_id, vec_id // 10 AS doc_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id < 8)"


def _pseudo(spark: SparkSession, sf: str) -> tuple[DataFrame, np.ndarray]:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    docs = e.groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("embedding"))
    few = e.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()
    return docs, np.array([r[0] for r in few], np.float64)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12), 6) AS l1 FROM embeddings")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    return rows.select("vec_id", F.round(F.aggregate(T.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("l1"))


_MAXSIM = f"WITH {_DOC}, m AS (SELECT doc_id, qid, max(list_inner_product(qv, v)) AS s FROM e CROSS JOIN q GROUP BY 1, 2)"


@query(f"{_MAXSIM} SELECT doc_id, round(sum(s), 6) AS score FROM m GROUP BY doc_id")
def maxsim_batch(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _pseudo(spark, sf)
    return _six(maxsim.score(docs, q))


@query(f"{_MAXSIM} SELECT doc_id, round(sum(s), 6) AS score FROM m GROUP BY doc_id")
def maxsim_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The kernel for one pair, on each document by itself."""
    docs, q = _pseudo(spark, sf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [maxsim.maxsim(q, np.array(m, np.float64)) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pairs, pa.float64())], ["doc_id", "score"])

    return _six(docs.mapInArrow(run, "doc_id long, score double"))


@query(f"{_MAXSIM} SELECT doc_id, round(sum(s), 6) AS score FROM m GROUP BY doc_id ORDER BY 2 DESC, 1 LIMIT 10")
def maxsim_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _pseudo(spark, sf)
    return _six(maxsim.score(docs, q)).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT DISTINCT vec_id // 10 AS doc_id, 0::DOUBLE AS score FROM embeddings")
def maxsim_empty(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _pseudo(spark, sf)
    return maxsim.score(docs, q[:0])


@query(f"{_MAXSIM} SELECT doc_id, round(sum(s) / 8, 6) AS score FROM m GROUP BY doc_id")
def maxsim_mean(spark: SparkSession, sf: str) -> DataFrame:
    docs, q = _pseudo(spark, sf)
    return _six(maxsim.score(docs, q, mean=True))


# two lists of scores: all matches of two searches, which share some documents
_LISTS = f"{_POSTINGS.strip()}, a AS (SELECT d AS id, round(sum(s), 9) AS s FROM w WHERE term IN ('the', 'of', 'ing') GROUP BY d), b AS (SELECT d AS id, round(sum(s), 9) AS s FROM w WHERE term IN ('der', 'of', 'que', 'tion') GROUP BY d)"
_NORM = "na AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM a), nb AS (SELECT id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM b)"


def _lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    index = _plain(spark, sf)
    found = lambda text: index.matches(parse(text)).select(F.col("chunk_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return stored(found("the of ing"), "list"), stored(found("der of que tion"), "list")


@query(f"WITH {_LISTS}, {_NORM} SELECT id AS doc_id, round(s, 6) AS score FROM na")
def minmax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _six(fusion.minmax(_lists(spark, sf)[0]))


_FUSED = f"WITH {_LISTS}, {_NORM} SELECT coalesce(na.id, nb.id) AS doc_id, round(@w * coalesce(na.s, 0) + (1 - @w) * coalesce(nb.s, 0), 6) AS score FROM na FULL JOIN nb ON na.id = nb.id"


@query(_FUSED.replace("@w", "0.3::DOUBLE"))
def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _six(fusion.weighted(*_lists(spark, sf)))


@query(_FUSED.replace("@w", "0.8::DOUBLE"))
def weighted_fusion_bias(spark: SparkSession, sf: str) -> DataFrame:
    return _six(fusion.weighted(*_lists(spark, sf), weight=0.8))


_RANKED = f"WITH {_LISTS}, r AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) AS s FROM a UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM b@more) SELECT id AS doc_id, round(sum(s), 6) AS score FROM r GROUP BY id"


@query(_RANKED.replace("@more", ""))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _six(fusion.reciprocal_rank(*_lists(spark, sf)))


@query(_RANKED.replace("@more", " UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s, id)) FROM a"))
def rrf_three_way(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _lists(spark, sf)
    return _six(fusion.reciprocal_rank(a, b, a.withColumn("score", -F.col("score"))))


@query(f"WITH RECURSIVE {_FILES}, {_CHUNKS}, {_NAMED}, {_FORMATTED} SELECT sha256(formatted) AS hash, least(128, 2 + len({_TOKENS.replace('(text,', '(formatted,')}))::INT AS num_tokens, least(128, 2 + len({_TOKENS.replace('(text,', '(formatted,')}))::INT AS rows, NULL::VARCHAR AS error FROM form")
def encode_hash_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return HashEncoder().encode_table(_chunks(spark, sf)).select("hash", "num_tokens", F.size("embedding").alias("rows"), "error")


def _hybrid(spark: SparkSession, sf: str, text: str, stemmed: bool = False) -> DataFrame:
    """Search with the vectors of all chunks stored, as an Engine has them."""
    index, chunks = _stemmed(spark, sf, stemmed)
    encoder = HashEncoder(32, stemmed)
    store = VectorStore(spark, folder(spark, "vectors"), 32, encoder)
    store.encode(chunks)
    return engine.hybrid(index, chunks, store, text, encoder.encode(text, "query"), 10)


@query(f"{_OVER_CHUNKS}, {_fused_files('things', 'tion', 'under', 'the')} SELECT * FROM found")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Without stems, which SQL can't make."""
    return _hybrid(spark, sf, "things tion under the")


@query()
def hybrid_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, "things running under the", True)


@query(f"{_OVER_CHUNKS}, {_best_files('things', 'tion', 'under', 'the')} SELECT path, round(s, 6) AS bm25_score, NULL::DOUBLE AS semantic_score, round(s, 6) AS fusion_score FROM lexical ORDER BY 4 DESC, 1 LIMIT 10")
def hybrid_fallback(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = _stemmed(spark, sf, False)
    return engine.bm25_only(index, "things tion under the", 10)


@query(f"""{_OVER_CHUNKS}, {_fused_files('the', 'of')} SELECT '{{"path":"' || path || '","bm25_score":' || bm25_score || ',"colbert_score":' || semantic_score || ',"fusion_score":' || fusion_score || '}}' AS json FROM found""")
def search_json(spark: SparkSession, sf: str) -> DataFrame:
    return engine.json_rows(_hybrid(spark, sf, "the of"))
