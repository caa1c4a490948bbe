"""The context tree's scores against a dictionary of all nodes."""

import math
from collections import defaultdict

import numpy as np
import pytest

from quernel.llm import ctw

EDGE = bytes([ctw.EDGE])


def steps(text, depth):
    """For each byte and end mark: its eight (choice node, bit), and the depth bytes before it."""
    raw = EDGE * depth + text.lower().encode() + EDGE
    for i in range(depth, len(raw)):
        yield [((256 | raw[i]) >> (k + 1), raw[i] >> k & 1) for k in range(7, -1, -1)], raw[i - depth : i]


def brute(texts, depth):
    """log10 of a text by a model of all nodes of texts, none left out."""
    count, longer = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in texts:
        for nodes, before in steps(t, depth):
            for node, bit in nodes:
                for d in range(depth + 1):
                    count[node, before[depth - d :]][bit] += 1
                    if d:
                        longer[node, before[depth - d + 1 :]].add((node, before[depth - d :]))
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1) for k, (a, b) in count.items()}
    pw, stop = {}, {}
    for k in sorted(count, key=lambda k: -len(k[1])):
        pw[k], stop[k] = kt[k], 1.0
        if len(k[1]) < depth:
            pw[k] = np.logaddexp(kt[k], sum(pw[x] for x in longer[k])) + math.log(0.5)
            stop[k] = math.exp(math.log(0.5) + kt[k] - pw[k])

    def log10(text):
        total = 0.0
        for nodes, before in steps(text, depth):
            for node, bit in nodes:
                left, mixed, last = 1.0, 0.0, 0.5
                for d in range(depth + 1):
                    if (k := (node, before[depth - d :])) not in count:
                        break
                    a, b = count[k]
                    last = (b + 0.5) / (a + b + 1)
                    mixed, left = mixed + left * stop[k] * last, left * (1 - stop[k])
                p = mixed + left * last
                total += math.log10(p if bit else 1 - p)
        return total

    return log10


def sentences(n, seed, size=12):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(80)]
    return [" ".join(rng.choice(words, size)) for _ in range(n)]


def split(rows):
    """Training texts and all others, by the fold of score_texts."""
    import zlib

    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    return [t for (_, t), h in zip(rows, held, strict=True) if not h]


def whole(counts, depth):
    """All nodes, from the counts of all buckets."""
    model = ctw.Tables.short(counts, depth)
    parts = [ctw.unpack(bytes(r.blob), 2) for r in counts.where("kind = 0").collect()]
    model.put_long(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
    return model


def test_no_node_is_evicted(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 40)) for _ in range(200)] * 2
    counts = ctw.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    model = whole(counts, 5)
    log10 = brute(texts, 5)
    for t in [*texts[:5], "abc abc", ""]:
        raw = np.frombuffer(t.encode(), np.uint8)
        code, _ = ctw.grams(raw, np.array([0, len(raw)]), 5)
        assert model.log10(code).sum() == pytest.approx(log10(t), rel=1e-5)


@pytest.mark.parametrize("hot", [0, 100, 1 << 20])
def test_scores_of_joined_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    rows = list(enumerate(sentences(40, 2) * 2 + [None, "", "aaaaaaaaaaaa" * 30, "Zz zz"] * 2))
    rows = [(2 * i + k, t) for i, t in rows for k in (0, 1)]
    train = split(rows)
    twice = [(i, t) for i, t in rows] + [(i, t) for i, t in rows]  # each training gram at least twice
    got = ctw.score_texts(spark.createDataFrame(twice, "doc_id long, text string"), depth=5).collect()
    log10 = brute([t or "" for t in train] * 2, 5)
    want = {t: log10(t or "") for t in {t for _, t in rows}}
    text = dict(rows)
    assert len(got) == len(twice)
    for r in got:
        assert r.score == pytest.approx(want[text[r.doc_id]], rel=1e-5)


def test_six_context_bytes(spark):
    rows = [(i, "xabcdeq" if i % 2 else "yabcdez") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own, six, five = ({r.doc_id: r.score for r in ctw.score_texts(docs, **k).collect()} for k in ({}, {"depth": 6}, {"depth": 5}))
    log10 = brute(split(rows), 6)
    for i, t in rows[:2]:
        assert own[i] == six[i] == pytest.approx(log10(t), rel=1e-5) and own[i] > five[i] + 0.2


def test_nodes_seen_once_are_kept(spark):
    rows = [*enumerate(sentences(120, 3))]
    log10 = brute(split(rows), 6)
    got = {r.doc_id: r.score for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(log10(t), rel=1e-5)


def test_packed_columns_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 5, 3000):
        key = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        more = rng.integers(1 << 40, (1 << 40) + 70_000, n), rng.integers(0, 3, n)
        got = ctw.unpack(ctw.pack(key, *more), 3)
        assert got[0].tolist() == key.tolist() and [g.tolist() for g in got[1:]] == [m.tolist() for m in more]


def test_small_gatherings_give_the_same(spark, monkeypatch):
    rows = [*enumerate(sentences(150, 8) + ["", None, "x" * 700] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {r.doc_id: r for r in ctw.score_texts(docs).collect()}
    for name, value in (("SORTED", 300), ("GATHERED", 400), ("HOT_GRAMS", 50), ("HOT_WORDS", 5)):
        monkeypatch.setattr(ctw, name, value)
    got = {r.doc_id: r for r in ctw.score_texts(docs).collect()}
    assert len(got) == len(want) == len(rows)
    for i, r in want.items():
        assert (got[i].n_known, got[i].n_tokens, got[i].train_tokens) == (r.n_known, r.n_tokens, r.train_tokens)
        assert got[i].score == pytest.approx(r.score, rel=1e-6) and got[i].base_score == pytest.approx(r.base_score, rel=1e-9)
