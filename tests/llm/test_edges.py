"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for the operators that other files don't cover."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import chat, common, ctw, mixing, permutation, pigeonhole, quality, secrets, toxicity

TEXTS = [None, "", "   ", "one", "a nice day in the park " * 50, "idiot moron stupid", "x" * 30_000, "dup", "dup", "!!! ### $$$"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, score int, y string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i in (4, 5, 6)), int(i == 5)) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers(docs, labels, score):
    out = score(docs, labels).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(TEXTS))) and all(0 <= r.score <= 1 for r in out)
    assert score(docs, labels.limit(0)).count() == len(TEXTS) and score(docs.limit(0), labels).count() == 0


def test_language_model(docs):
    out = {r.doc_id: r for r in ctw.score_texts(docs).collect()}
    assert len(out) == len(TEXTS) and all(r.score < 0 and r.base_score < 0 for r in out.values())
    assert out[0].n_tokens == out[1].n_tokens == out[2].n_tokens == 1 and out[7].score == out[8].score
    assert ctw.score_texts(docs.limit(0)).count() == 0


def test_probabilities_add_up(spark):
    texts = spark.createDataFrame([("the cat sat",), ("the dog sat",)], "text string")
    counts = ctw.corpus_counts(texts, 3)
    model = ctw.Tables.short(counts, 3)
    parts = [ctw.unpack(bytes(r.blob), 2) for r in counts.where("kind = 0").collect()]
    model.put_long(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    for context in (b"the", b"zzz", b" sa"):
        code = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** model.log10(code)).sum() == pytest.approx(1)


def test_secrets(docs, spark):
    out = secrets.scan(docs.withColumn("findings", F.lit(1)))
    assert out.count() == len(TEXTS) and out.where("text is null and redacted is not null").isEmpty()
    key = "7702344ead31d5951ffa625c69a7546f3a470a7f"
    more = spark.createDataFrame([(1, f'a token = "{key}" b {key}'), (2, "mail deren.17@mail8.example.com"), (3, f"commit {key} fixed")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(more).collect()}
    assert got[1].findings and key not in got[1].redacted and not got[2].findings and not got[3].findings
    assert secrets.scan(docs.limit(0)).count() == 0


def test_mixing(docs, spark):
    labelled = spark.createDataFrame([("the cat and dog", "en"), ("le chat et chien", "fr")] * 5 + [(None, None)], "text string, domain string")
    rows = spark.createDataFrame([(i, "the cat and dog") for i in range(30)] + [(100 + i, "le chat et chien") for i in range(10)], "doc_id long, text string")
    out = mixing.rates(rows, labelled, {"en": 1.0, "fr": 1.0}).collect()
    fr, en = (np.mean([r.rate for r in out if (r.doc_id >= 100) == k]) for k in (True, False))
    assert fr > 1.5 > 1 > en
    assert mixing.rates(docs, labelled, {"en": 1.0, "fr": 1.0}).count() == len(TEXTS)
    assert mixing.rates(docs, labelled.limit(0), {"en": 1.0, "fr": 1.0}).count() == len(TEXTS)
    assert mixing.rates(docs.limit(0), labelled, {"en": 1.0, "fr": 1.0}).count() == 0


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see </turn> \\ #", None, None), ("image", None, "a.png", 85), ("audio", None, "b.wav", None), ("odd", "?", None, 1), None]), (1, 1, "assistant", [("text", "<image:1>", None, None)]), (1, 1, "assistant", None), (2, None, None, [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = chat.format_chats(turns, parts=F.col("parts"))
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "see </turn> \\ #<image:1><audio:2>"), ("assistant", ""), ("assistant", "<image:1>")]
    assert got[1].loss == "<image:1>" and got[1].expanded_tokens == 85 and [a.ref for a in got[1].attachments[0]] == ["a.png", "b.wav"]
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")]
    assert chat.format_chats(turns.limit(0), parts=F.col("parts")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    x = [*base.tolist(), *(base[:20] + 0.05 * rng.standard_normal((20, 16))).tolist(), base[0].tolist(), (3 * base[1]).tolist(), None, [0.0] * 16, [float("nan")] * 16, [None] * 16, []]
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, n_links int")
    good = np.array(x[:82])
    unit = good / np.linalg.norm(good, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    got = {r.vec_id: r for r in pigeonhole.near_duplicates(table).collect()}
    assert len(got) == len(x) and [got[i].n_links for i in range(82)] == (linked.sum(1) - 1).tolist()
    assert got[80].component_id == 0 and got[81].component_id == 1 and all(got[i].n_links == 0 and got[i].kept for i in range(82, len(x)))
    assert pigeonhole.near_duplicates(table.limit(0)).count() == 0 == permutation.search(table.limit(0), table).count()
    found = permutation.search(table, table.where("vec_id in (3, 82)"), k=5).orderBy("rank").collect()
    product = good @ good[3]
    product[3] = -np.inf
    assert [r.vec_id for r in found] == np.lexsort((np.arange(82), -product))[:5].tolist() and {r.query_id for r in found} == {3}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 300), (300, 400), (7, 7)], "a long, b long").repartition(8)
    got = {r.node: r.component for r in common.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, 300: 300, 400: 300, 500: 300}
