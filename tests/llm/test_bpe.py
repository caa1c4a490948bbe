import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from quernel.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    r = bpe.Ranks(open(PATH, "rb").read(), P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=r.rank, special_tokens={})


def test_round_trip_and_ids(spark):
    enc = reference()
    texts = [None, "", " ", "a" * 5000, "x  y\n\n z", "日本語テキスト" * 300, "<|endoftext|>", "\x00\x7f", "é́́", "Thtion be, esaned!!  "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    assert [list(ids[i]) for i in range(len(texts))] == [enc.encode_ordinary(t or "") for t in texts]
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_documents(spark):
    enc = reference()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_merging_side_by_side_gives_what_one_by_one_gives():
    enc, rng = reference(), np.random.default_rng(5)
    ranks = bpe.Ranks(open(PATH, "rb").read(), P.PATTERN)
    tokens = [t for t in ranks.rank if len(t) > 1]
    pieces = {bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in rng.integers(2, 34, 2000)} | {(tokens[a] + tokens[b])[:33] for a, b in rng.integers(0, len(tokens), (2000, 2))}
    for width in (1, 2, 4, 8, 16, 32):
        some = sorted(p for p in pieces if len(p) >= 2 and 1 << (len(p) - 2).bit_length() == width and p not in ranks.rank)
        for p, ids in zip(some, ranks.merge_many(some, width) if some else [], strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ranks.merge(p) == enc._core_bpe.encode_single_piece(p)


def test_generations_forget_without_changing_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    enc, rng = reference(), np.random.default_rng(6)
    ranks = bpe.Ranks(open(PATH, "rb").read(), P.PATTERN)
    texts = ["".join(chr(c) for c in rng.choice([32, 97, 98, 233, 20013, 49], rng.integers(0, 300))) + "q" * int(rng.integers(0, 90)) for _ in range(300)]
    for i in range(0, 300, 30):
        got = ranks.encode_all(texts[i : i + 30])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [enc.encode_ordinary(t) for t in texts[i : i + 30]]
