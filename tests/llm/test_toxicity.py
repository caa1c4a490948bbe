"""The label model against its formula, its correction of wrong labels, and patterns against plain strings."""

import math
import re

import numpy as np
import pytest

from quernel.llm import toxicity


def planted(rows=3000, seed=3):
    """True classes, votes of twelve voters of two topics (two of them copies of others), and labels of which a tenth is wrong."""
    rng = np.random.default_rng(seed)
    truth = (rng.random(rows) < 0.2).astype(int)
    topic = rng.integers(0, 2, rows)
    p = np.where(truth[:, None] == 1, np.where(np.arange(10)[None] // 5 == topic[:, None], 0.6, 0.003), 0.003)
    votes = (rng.random((rows, 10)) < p).astype(np.uint8)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 5]])
    wrong = rng.random(rows) < 0.1
    return truth, votes, np.where(wrong, 1 - truth, truth), wrong


def test_wrong_labels_are_corrected():
    truth, votes, gold, wrong = planted()
    model, q = toxicity.LabelModel.fit(votes, gold, np.arange(len(gold)) % 2 == 0)
    clear = (votes[:, :10].sum(1) > 1) | (votes.sum(1) == 0) & (truth == 0)  # where the votes outweigh one label
    assert ((q > 0.5) == truth)[clear & wrong].mean() > 0.95 and (clear & wrong).sum() > 200
    assert ((q > 0.5) == truth).mean() > 0.97 > (gold == truth).mean()
    assert model.gold == pytest.approx([0.9, 0.9], abs=0.03)
    assert model.accuracy[1, :10] == pytest.approx(votes[truth == 1][:, :10].mean(0), abs=0.05)
    assert {model.parent[10], model.parent[0]} & {0, 10} and {model.parent[11], model.parent[5]} & {5, 11}  # copies hang together


def test_posteriors_are_those_of_the_model():
    _, votes, gold, _ = planted(300)
    model, q = toxicity.LabelModel.fit(votes, gold)
    for v, g, got in zip(votes.tolist(), gold.tolist(), q, strict=True):
        p = [1 - model.prior, model.prior]
        for y in (0, 1):
            p[y] *= model.gold[y] if g == y else 1 - model.gold[y]
            for k, x in enumerate(v):
                one = model.table[y, v[model.parent[k]] if model.parent[k] >= 0 else 0, k]
                p[y] *= one if x else 1 - one
        assert got == pytest.approx(p[1] / sum(p), abs=1e-9)


def test_patterns_are_words_and_their_beginnings():
    texts = ["Réeuxpa idiot, IDIOTS x", "", "idiot-réeuxpa 1abc"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    key, doc = toxicity.patterns(np.frombuffer(raw, np.uint8), off)
    got = [set(key[doc == i].tolist()) for i in range(3)]
    want = []
    for t in texts:
        words = [w.encode() for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        want.append({(k, w[:k] if k else w) for w in words for k in toxicity.PREFIXES if k == 0 or len(w) > k})
    for a in range(3):
        assert len(got[a]) == len(want[a])
        for b in range(3):
            assert len(got[a] & got[b]) == len(want[a] & want[b])
    assert toxicity.word_pattern("idiot") in got[0].__class__(x - (1 << 64) if x >> 63 else x for x in got[0])


def test_linear_classifier_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.random((400, 6)) < 0.3
    q = 1 / (1 + np.exp(-(x @ [2.0, -1, 0, 3, 0.5, 0] - 1)))
    row, column = np.nonzero(x)
    weight, offset = toxicity.fit_linear(row, column, 6, q, ridge=1e-3, steps=3000)
    p = 1 / (1 + np.exp(-(x @ weight + offset)))
    assert np.abs(x.T @ (p - q) / 400 + 1e-3 * weight).max() < 1e-6 and abs((p - q).mean()) < 1e-6


def test_repeated_ids_and_odd_rows(spark):
    bad, good = "you stupid worthless idiot", "a fine day for the sea and the hills"
    rows = [(i, f"{bad if i % 4 == 0 else good} {i % 7}") for i in range(120)] + [(4, bad)] * 50 + [(None, bad), (500, None), (501, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS q", "0 AS y")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] * 2 + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id is None or r.doc_id % 4 == 0) for r in got if r.doc_id is None or r.doc_id < 120 and r.doc_id != 4)
    assert all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert sum(r.predicted for r in got if r.doc_id == 4) == 51 and not any(r.predicted for r in got if r.doc_id in (500, 501))
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    alone = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).where("doc_id < 8").collect()}
    assert alone[0] == 1 and alone[1] == 0
