import json
import os

import numpy as np
import pytest

from quernel.functions import text as T
from quernel.functions.stemmer import stem
from quernel.operators import fusion, maxsim, transformer
from quernel.operators.bm25 import Index, postings, tokens
from quernel.operators.chunking import batch_rows, chunk, chunk_rows, spans, token_batches
from quernel.operators.encoder import HashEncoder
from quernel.operators.query_parser import parse
from quernel.operators.vector_store import VectorStore
from quernel.plans.engine import Engine, json_rows
from quernel.sources.directory import read_directory, walk
from pyspark.sql import functions as F


def test_chunks():
    small = "SELECT 1\n  FROM t\n WHERE x = 'y'"
    assert list(spans(small)) == [(small, 0, len(small), 0)]
    got = list(spans("".join(f"line {i:04d} of a long file\n" for i in range(90)), 400, 80))
    assert len(got) > 5 and got[0][1] == 0 and all(b[1] < a[2] for a, b in zip(got, got[1:], strict=False))
    assert list(spans("")) == list(spans(None)) == list(spans(" \t\n \n\n")) == []
    long = "a" * 4000 + "\n" + "é" * 10
    assert [c[1:] for c in spans(long)] == [(0, 4001, 0), (4001, 4021, 1)]
    text = "a\r\n" * 800
    raw = text.encode()
    assert all(raw[s:e].decode().rstrip() == c for c, s, e, _ in spans(text))


def test_chunks_are_handed_on_in_small_batches():
    import pyarrow as pa

    texts = [f"line {i} of a text\n" * 20_000 for i in range(20)] + [None, " \n"]
    made = list(chunk_rows(iter([pa.RecordBatch.from_arrays([pa.array(map(str, range(22))), pa.array(texts)], ["path", "content"])])))
    assert max(b.nbytes for b in made) < 4 << 20 and len(made) > 5
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert got == [(str(p), i, *c) for p, t in enumerate(texts) for i, c in enumerate(spans(t))]


def test_chunk_ids(spark):
    rows = spark.createDataFrame([("lib/util.py#chunk12",), ("a#chunk1#chunk2",), ("a#chunkx",), ("a",), ("a#chunk5\n",)], "id string")
    got = [r.p and (r.p.path, r.p.n) for r in rows.select(T.parse_chunk_id(F.col("id")).alias("p")).collect()]
    assert got == [("lib/util.py", 12), ("a#chunk1", 2), None, None, None]


def test_tokens_and_stems(spark):
    rows = spark.createDataFrame([("readFileLines",), ("read_file_lines",), ("XMLParser",)], "t string")
    assert [r[0] for r in rows.select(T.code_tokens(F.col("t"))).collect()] == [["read", "file", "lines"], ["read", "file", "lines"], ["xmlparser"]]
    for word, want in {"running": "run", "runs": "run", "users": "user", "parse": "pars", "caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "generous": "generous", "happily": "happili", "sky": "sky", "national": "nation"}.items():
        assert stem(word) == want


@pytest.mark.parametrize(
    ("docs", "query", "top"),
    [
        ([("cat.py", "def feed_cat(): return 'fish'"), ("dog.py", "def walk_dog(): return 'stick'")], "fish", "cat.py"),
        ([("jumps.sql", "select jumping from t"), ("swims.sql", "select swimming from t")], "jump", "jumps.sql"),
        ([("m.go", "func openDoorWide() {}"), ("n.go", "func openWindow() {}")], "door", "m.go"),
        ([("p.go", "func countSheep() {}"), ("q.go", "func countStars() {}")], "star", "q.go"),
    ],
)
def test_bm25(spark, docs, query, top):
    index = Index.build(spark.createDataFrame(docs, "path string, content string"), "path", "content")
    assert index.search(query, 10).first()["chunk_id"] == top


def test_phrases_keep_the_gaps_of_long_words(spark, tmp_path):
    long = "z" * 50
    docs = [("with", f"red {long} green"), ("without", "red green"), ("both", f"green red {long} green red green"), ("none", "")]
    index = Index.build(spark.createDataFrame(docs, "path string, content string"), "path", "content")
    index.write(str(tmp_path / "i"))
    for i in (index, Index.read(spark, str(tmp_path / "i"))):
        hits = lambda q: sorted(r["chunk_id"] for r in i.search(q, 10).collect())  # noqa: B023, E731
        assert hits(f'"red {long} green"') == ["both", "with"] and hits('"red green"') == ["both", "without"]
        assert i.analyse(f"Red {long} greens") == [(0, "red"), (2, "green")]
        assert i.corpus.first()["n"] == 4 and i.corpus.first()["avgdl"] == 9 / 4
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["corpus", "postings", "terms"]


def test_postings_stay_with_their_documents(spark, tmp_path):
    docs = spark.range(4000).select(F.concat(F.lit("d"), F.col("id")).alias("path"), F.concat(F.lit("the word "), F.col("id")).alias("content")).repartition(8)
    Index.build(docs, "path", "content").write(str(tmp_path / "i"))
    kept = Index.read(spark, str(tmp_path / "i")).postings
    assert kept.where("term = 'the'").groupBy(F.input_file_name()).count().count() == 8  # a frequent term in all files, not in one
    texts = ["camelCase ABCdefGh x1Y2 \u201cÉtéÀ\u201d", "日本 wordÜber", None, "", "ΣΑΣ İx bB", "the " * 3 + "Ünder", " - ", "²½ aªB " + "z" * 40 + " z" + "é" * 19]
    rows = spark.createDataFrame(list(enumerate(texts)), "path int, content string").select(F.col("path").cast("string").alias("path"), "content").coalesce(1)
    want = tokens(rows, "path", "content").groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    got = postings(rows, "path", "content", False)
    assert sorted(map(tuple, got.select("term", "chunk_id", "tf", "positions").collect())) == sorted(map(tuple, want.collect()))
    long = {r.chunk_id: r.dl for r in got.select("chunk_id", "dl").distinct().collect()}
    assert long == {r[0]: r[1] for r in want.groupBy("chunk_id").agg(F.sum("tf")).collect()}


def test_postings_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(str(i), "a b") for i in range(10)], "path string, content string")
    index = Index.build(docs, "path", "content")
    index.postings = index.postings.mapInArrow(counted, index.postings.schema)
    index.terms, index.corpus = Index.statistics(index.postings, index.n)
    index.write(str(tmp_path / "i"))
    assert made.value == 20 and Index.read(spark, str(tmp_path / "i")).corpus.first()["avgdl"] == 2


def test_phrases_join_lists_of_positions(spark):
    docs = [("a", "of the of the the"), ("b", "the of"), ("c", "the the the"), ("d", "of of the")]
    index = Index.build(spark.createDataFrame(docs, "path string, content string"), "path", "content", stemmed=False)
    found = index.leaf(parse('"of the"'))
    assert sorted(r.chunk_id for r in found.collect()) == ["a", "d"]
    assert sorted(r.chunk_id for r in index.leaf(parse('"the the"')).collect()) == ["a", "c"]
    assert "explode(positions" not in found._jdf.queryExecution().toString()  # not a row an occurrence


def test_many_queries_at_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i:03d}", " ".join(rng.choice(words, int(rng.integers(1, 40))))) for i in range(300)]
    docs += [(f"copy{i}", docs[0][1]) for i in range(9)]
    index = Index.build(spark.createDataFrame(docs, "path string, content string"), "path", "content", stemmed=False)
    asked = spark.createDataFrame([(int(q), w) for q in range(300) for w in rng.choice([*words, "none"], 4, replace=False)], "item_id long, term string")
    rows = lambda df: sorted(map(tuple, df.select("item_id", "chunk_id", "score", "rank").collect()))
    found = rows(index.best(asked))
    monkeypatch.setattr("quernel.operators.bm25.ASKED", 5)
    assert found == rows(index.best(asked)) and len(found) == 1500


def test_a_store_packs_matrices(spark, tmp_path):
    encoder = HashEncoder(32)
    texts = spark.createDataFrame([(f"h{i % 90}", f"words of text {i % 90}") for i in range(100)], "hash string, formatted string")
    store = VectorStore(spark, str(tmp_path / "v"), 32, encoder)
    store.encode(texts.where("hash < 'h5'"))
    store.encode(texts)
    got = {r.hash: r for r in store.table().collect()}
    assert len(got) == len(store) == 90 and spark.read.parquet(str(tmp_path / "v")).dtypes[-1] == ("packed", "binary")
    for r in encoder.encode_table(texts.dropDuplicates(["hash"])).collect():
        assert got[r.hash].embedding == r.embedding and got[r.hash].num_tokens == r.num_tokens  # nothing is lost
    assert store.get("h7").shape == (6, 32)


def test_words_in_python_are_those_in_sql(spark):
    texts = ["Ünïcode camelCase ABCdef x1y2 ", "ÀéÎ straßeLang 日本語テキスト", "", "a_b-c.d", "ǅungla ΣΑΣ İx"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_tokens(F.col("t")).alias("w")).collect()
    for r in rows[:4]:
        assert r.w == T.code_words(r.t)


def test_batches(spark):
    rng = np.random.default_rng(0)
    rows = [(f"p{p:02d}", i, int(rng.choice([5, 300, 3000, 20_000], p=[0.5, 0.3, 0.15, 0.05]))) for p in range(8) for i in range(130)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(p, int(i), int(t)) for p, i, t in rows], "path string, chunk_idx int, tokens long")
    got = {(r.path, r.chunk_idx): (r.group, r.batch) for r in token_batches(table, F.substring("path", 3, 1).cast("int") % 2).collect()}
    for g in ("0", "1"):
        want, batch, count, total = {}, 0, 0, 0
        for p, i, t in sorted((p, int(i), int(t)) for p, i, t in rows if int(p[2]) % 2 == int(g)):
            if count and (count == 64 or total + t > 8192):
                batch, count, total = batch + 1, 0, 0
            count, total = count + 1, total + t
            want[p, i] = (g, batch)
        assert {k: v for k, v in got.items() if v[0] == g} == want and batch > 10


def test_batches_go_on_over_arrow_batches():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = [{"group": str(g), "path": "p", "chunk_idx": i, "tokens": int(rng.integers(10, 900))} for g in range(3) for i in range(400)]
    whole = [b.to_pylist() for b in batch_rows(iter([pa.RecordBatch.from_pylist(rows)]))]
    parts = [b.to_pylist() for b in batch_rows(pa.RecordBatch.from_pylist(rows[i : i + 7]) for i in range(0, len(rows), 7))]
    assert whole[0] == sum(parts, []) and len(parts) == -(-len(rows) // 7) and [*whole[0][0]] == ["group", "path", "chunk_idx", "batch"]


def test_workers_load_no_pandas():
    import subprocess
    import sys

    code = "import sys, quernel.operators.encoder, quernel.operators.chunking; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_query_language(spark):
    docs = [("a", "red green"), ("b", "green red"), ("c", "red"), ("d", "blue")]
    index = Index.build(spark.createDataFrame(docs, "path string, content string"), "path", "content")
    hits = lambda q: sorted(r["chunk_id"] for r in index.search(q, 10).collect())
    assert hits("red blue") == ["a", "b", "c", "d"]
    assert hits('"red green"') == ["a"] and hits("redGreen") == ["a"]
    assert hits("red -green") == ["c"] and hits("+red +green") == ["a", "b"] and hits("red AND green") == ["a", "b"]
    assert hits("(red OR blue) AND NOT green") == ["c", "d"] and hits("content:blue^2") == ["d"] and hits("") == []
    for bad in ('"open', "(red", "red AND", "title:red", "re*"):
        with pytest.raises(ValueError, match="failed to parse query"):
            parse(bad)


def test_fusion(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id string, score double")
    as_dict = lambda df: {r["doc_id"]: r["score"] for r in df.collect()}
    got = as_dict(fusion.reciprocal_rank(table([("x", 9.0), ("y", 8.0), ("z", 7.0)]), table([("y", 0.9), ("x", 0.8), ("w", 0.7)])))
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) == got["y"] and got["w"] == got["z"] == pytest.approx(1 / 63)
    many = [(f"d{i % 97:02d}{i}", float(i % 13)) for i in range(500)]
    order = sorted(many, key=lambda r: (-r[1], r[0]))
    assert {r["doc_id"]: r["rank"] for r in fusion.ranked(table(many)).collect()} == {d: k for k, (d, _) in enumerate(order, 1)}
    pair = table([("x", 4.0), ("y", 3.0)]), table([("y", 7.0), ("x", 6.0)])
    assert as_dict(fusion.weighted(*pair, weight=0.5)) == {"x": 0.5, "y": 0.5}
    biased = as_dict(fusion.weighted(*pair, weight=0.8))
    assert biased["x"] > biased["y"]
    assert as_dict(fusion.minmax(table([("a", 3.0), ("b", 3.0)]))) == {"a": 1.0, "b": 1.0}
    files = fusion.chunks_to_files(spark.createDataFrame([("m.py#chunk3", 0.2), ("m.py#chunk9", 0.6), ("n.py#chunk0", 0.5)], "chunk_id string, score double"))
    assert as_dict(files) == {"m.py": 0.6, "n.py": 0.5}
    empty = table([])
    assert fusion.weighted(empty, empty).count() == 0 and fusion.reciprocal_rank(empty).count() == 0


def test_maxsim(spark):
    eye = np.eye(2)
    assert maxsim.maxsim(np.eye(3)[:2], np.eye(3)[:2]) == 2.0 and maxsim.maxsim(eye, eye[:1]) == 1.0
    assert maxsim.maxsim(np.zeros((0, 2)), eye) == 0.0 == maxsim.maxsim(eye, np.zeros((0, 2)))
    assert maxsim.maxsim(eye[:1], np.array([[0.5, 0], [0.9, 0], [0.1, 0]])) == 0.9
    assert maxsim.maxsim(eye, np.array([[np.nan, 0], [1, 1]])) == 2.0
    with pytest.raises(ValueError, match="dimension mismatch"):
        maxsim.maxsim(eye, np.eye(3))
    docs = spark.createDataFrame([("i", [[1.0, 0.0], [0.0, 1.0]]), ("h", [[1.0, 0.0]]), ("e", [])], "doc_id string, embedding array<array<float>>")
    assert {r.doc_id: r.score for r in maxsim.score(docs, eye).collect()} == {"i": 2.0, "h": 1.0, "e": 0.0}
    rng = np.random.default_rng(1)
    matrices = [rng.standard_normal((int(n), 3)) for n in rng.integers(0, 6, 40)]
    matrices[7] = np.array([[np.nan, 1, 1], [1, 0, 2.0]])
    query, bound = rng.standard_normal((4, 3)), np.concatenate(([0], np.cumsum([len(m) for m in matrices])))
    assert maxsim.maxsim_batch(query, np.concatenate(matrices), bound) == pytest.approx([maxsim.maxsim(query, m) for m in matrices])
    with pytest.raises(ValueError, match="dimension mismatch"):
        maxsim.maxsim_batch(eye, np.eye(3), np.array([0, 3]))
    mixed = spark.createDataFrame([(0, [[1.0, 0.0]]), (1, None), (2, [[0.0, 1.0], [1.0, 0.0]]), (3, [])], "doc_id int, embedding array<array<float>>").coalesce(1)
    assert {r.doc_id: r.score for r in maxsim.score(mixed, eye).collect()} == {0: 1.0, 1: 0.0, 2: 2.0, 3: 0.0}


def test_encoder():
    e = HashEncoder()
    m = e.encode("hello world", "document")
    assert m.shape == (4, 128) and np.allclose(np.linalg.norm(m, axis=1), 1)
    assert np.array_equal(m, e.encode_batch(["hello world"], "document")[0])
    assert not np.array_equal(m, e.encode("hello world", "query")) and len(e.encode("word " * 1000, "document")) == 128


def test_an_encoder_holds_little(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from quernel.operators import encoder

    texts = ["a" * 20_000 + f" {i}" for i in range(2000)]  # 40 MB
    tracemalloc.start()
    sizes = [n for b in HashEncoder().encode_rows(iter([pa.RecordBatch.from_arrays([pa.array(map(str, range(2000))), pa.array(texts)], ["key", "text"])]), "document") for n in b.column(1).to_pylist()]
    assert sizes == [4] * 2000 and tracemalloc.get_traced_memory()[1] < 10e6
    tracemalloc.stop()
    monkeypatch.setattr(encoder, "REMEMBERED", 50)
    e, fresh = HashEncoder(32), [f"word{i} " + "b" * (200 + i) for i in range(300)]
    got = e.encode_batch(fresh, "document")
    assert len(e.known) <= 50 and max(map(len, e.known)) < 10
    assert all(np.array_equal(m, HashEncoder(32).encode(t, "document")) for m, t in zip(got, fresh, strict=True))


def test_a_failed_batch_falls_back_to_single_texts(spark):
    class Picky(HashEncoder):
        def encode_batch(self, texts, kind):
            if any("bad" in t for t in texts):
                raise ValueError("a bad text")
            return [HashEncoder.encode(self, t, kind) for t in texts]

    rows = spark.createDataFrame([(str(i), "bad" if i == 5 else f"good {i}") for i in range(100)], "hash string, formatted string").coalesce(1)
    got = {r.hash: r for r in Picky(16).encode_table(rows).collect()}
    assert len(got) == 100 and got["5"].error == "a bad text" and got["5"].num_tokens == 0 and got["5"].embedding == []
    assert all(got[str(i)].error is None for i in range(100) if i != 5)
    assert np.allclose(got["7"].embedding, HashEncoder(16).encode("good 7", "document"), atol=1e-6)


@pytest.fixture
def small_model(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    rng = np.random.default_rng(3)
    words = ["[CLS]", "[SEP]", "[UNK]", "[Q]", "[D]", *"abcdefghij"]
    tokenizer = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.post_processor = processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 0), ("[SEP]", 1)])
    tokenizer.save(str(tmp_path / "t.json"))
    width, inner = 16, 40
    shape = {"embeddings.word_embeddings.weight": (len(words), width), "embeddings.token_type_embeddings.weight": (1, width), "linear.weight": (8, width)}
    for name in transformer.names(2):
        part = name.rsplit(".", 2)[-2]
        rows, columns = {"Wqkv": (3 * width, width), "out_proj": (width, width), "fc1": (inner, width), "fc2": (width, inner)}.get(part, (width, width))
        shape.setdefault(name, (rows,) if name.endswith("bias") or "norm" in part or part == "emb_ln" else (rows, columns))
    np.savez(tmp_path / "w.npz", **{k: rng.standard_normal(v) * 0.3 for k, v in shape.items()})
    return transformer.TransformerEncoder(str(tmp_path / "w.npz"), str(tmp_path / "t.json"), 4, {"query": 3, "document": 4})


def test_transformer(spark, small_model):
    texts = ["a b c", "", "j", " ".join("abcdefghij" * 30), "a b d"]
    batch = small_model.encode_documents(texts)
    assert [len(m) for m in batch] == [6, 3, 4, 128, 6] and small_model.dim == 8
    for t, m in zip(texts, batch, strict=True):
        assert np.allclose(m, small_model.encode(t, "document"), atol=1e-5) and np.allclose(np.linalg.norm(m, axis=1), 1)
    assert not np.allclose(batch[0], small_model.encode("a b c", "query")) and small_model.encode_queries([]) == []
    assert not np.allclose(batch[0][:4], batch[4][:4])  # every place looks at all others
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "hash string, formatted string")
    for r in small_model.encode_table(rows).collect():
        assert np.allclose(r.embedding, batch[int(r.hash)], atol=1e-5) and r.error is None


def test_transformer_layers():
    rng = np.random.default_rng(0)
    q, k = rng.standard_normal((2, 1, 9, 1, 6))
    turned = transformer.rotated(q), transformer.rotated(k)
    assert np.allclose(np.linalg.norm(turned[0], axis=-1), np.linalg.norm(q, axis=-1)) and np.allclose(turned[0][:, 0], q[:, 0])
    same = np.repeat(q[:, :1], 9, 1), np.repeat(k[:, :1], 9, 1)
    dots = np.einsum("bihd,bjhd->ij", transformer.rotated(same[0]), transformer.rotated(same[1]))
    assert np.allclose(np.diag(dots, 2), dots[0, 2])  # products depend on distances only
    x = rng.standard_normal((2, 5, 7)) * 3 + 1
    y = transformer.layer_norm(x, np.ones(7), np.zeros(7))
    assert np.allclose(y.mean(-1), 0) and np.allclose(y.std(-1), 1, atol=1e-3)
    wide, w, b = rng.standard_normal((1, 4, 8)), rng.standard_normal((24, 8)), rng.standard_normal(24)
    out = rng.standard_normal((8, 8)), rng.standard_normal(8)
    whole = transformer.attention(wide[:, :3], np.ones((1, 3)), 2, (w, b), out)
    assert np.allclose(transformer.attention(wide, np.array([[1, 1, 1, 0]]), 2, (w, b), out)[:, :3], whole)
    assert transformer.gelu(np.array([0.0, 100.0, -100.0])).tolist() == [0.0, 100.0, 0.0]


def test_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"), 4)
    assert store.is_empty() and len(store) == 0
    row = lambda h, n: (h, n, [[float(i)] * 4 for i in range(n)])
    frame = lambda rows: spark.createDataFrame(rows, "hash string, num_tokens int, embedding array<array<float>>")
    store.insert(frame([row("a", 2), row("b", 3), row("a", 2)]))
    store.insert(frame([row("b", 3), row("c", 1)]))
    assert len(store) == 3
    asked = spark.createDataFrame([(0, "c"), (1, "x"), (2, "a"), (3, "c")], "ordinal int, hash string")
    assert [r.hash for r in store.lookup(asked).orderBy("ordinal").collect()] == ["c", "a", "c"]
    assert store.get("b").tolist() == [[float(i)] * 4 for i in range(3)]
    with pytest.raises(KeyError, match="x"):
        store.get("x")
    frame([("d", 5, [[1.0] * 4])]).write.mode("append").parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError, match="entry d"):
        store.get("d")
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no vector store"):
        VectorStore(spark, str(tmp_path / "other"), 4).table()
    with pytest.raises(Exception, match="expected vectors of 4"):
        store.insert(spark.createDataFrame([("z", 1, [[1.0]])], "hash string, num_tokens int, embedding array<array<float>>"))


def test_directory_index_and_search(spark, tmp_path):
    for name, data in {".hidden": b"secret plan", "src/a.py": b"def readFileLines(): pass\n", "src/b.py": b"def walk(): pass\n", "skip/x.py": b"lines", "big.txt": b"x" * 1_048_577, "bin": b"\xff\xfe", ".gitignore": b"skip/\n*.log\n!keep.log\n", "a.log": b"lines", "keep.log": b"lines log", ".git/config": b"lines"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    assert sorted(walk(str(tmp_path))) == [".gitignore", ".hidden", "big.txt", "bin", "keep.log", "src/a.py", "src/b.py"]
    engine = Engine(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="quernel index"):
        engine.search("lines")
    first = engine.index()
    assert (first["kept"], first["skipped_large"], first["skipped_binary"], first["embedded"], first["cached"]) == (5, 1, 1, 5, 0)
    again = engine.index()
    assert (again["embedded"], again["cached"]) == (0, 5)
    rows = engine.search("file lines").collect()
    assert rows[0].path == "src/a.py" and os.path.isdir(tmp_path / ".quernel")
    assert [r.path for r in engine.search("walking", bm25=True).collect()] == ["src/b.py"]
    found = [json.loads(r.json) for r in json_rows(engine.search("file lines")).collect()]
    assert list(found[0]) == ["path", "bm25_score", "colbert_score", "fusion_score"] and found[0]["path"] == "src/a.py"
    only = [json.loads(r.json) for r in json_rows(engine.search("file lines", bm25=True)).collect()]
    assert only[0]["colbert_score"] is None and only[0]["bm25_score"] == only[0]["fusion_score"]


def test_directory_source(spark, tmp_path, monkeypatch):
    home, root = tmp_path / "home", tmp_path / "root"
    (root / "deep").mkdir(parents=True)
    home.mkdir()
    for i in range(7):
        (root / "deep" / f"f{i}.txt").write_text(f"text {i}")
    (root / "x.tmp").write_text("left out")
    (home / ".gitconfig").write_text("[user]\n  name = n\n[core]\n\texcludesFile = ~/own-ignore\n")
    (home / "own-ignore").write_text("*.tmp\n")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    files = read_directory(spark, str(root), strict=True, per_task=3)
    assert sorted((r.path, r.content, r.status) for r in files.collect()) == [(f"deep/f{i}.txt", f"text {i}", "kept") for i in range(7)]
    assert files.rdd.getNumPartitions() == 3
    with pytest.raises(FileNotFoundError):
        read_directory(spark, str(root / "none"))
    (root / "empty").mkdir()
    assert read_directory(spark, str(root / "empty")).count() == 0


def test_chunk_table(spark):
    out = chunk(spark.createDataFrame([("p", "one\ntwo"), ("q", None)], "path string, content string")).collect()
    assert [(r.chunk_id, r.formatted, len(r.hash)) for r in out] == [("p#chunk0", "// p#chunk0\none\ntwo", 64)]
