"""The queries over whole tables, against brute force, held-out labels and a separate tokenizer."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quernel.llm import bpe, mixing, quality, queries, secrets

from test_minhash import brute

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding) and any(r.embedding)]
    return [r.vec_id for r in rows], np.array([i for i, _ in good]), np.array([v for _, v in good], float)


def test_links_of_embeddings(spark):
    ids, good, x = vectors(spark, SF)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    of = dict(zip(good.tolist(), linked.sum(1).tolist(), strict=True))
    component = good.copy()
    while True:
        low = np.array([min(component[i], component[linked[i]].min(initial=component[i])) for i in range(len(good))])
        if (low == component).all():
            break
        component = low
    smallest = dict(zip(good.tolist(), component.tolist(), strict=True))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_embedding_near_dedup(spark, SF).collect()}
    assert got == {i: (of.get(i, 0), smallest.get(i, i), smallest.get(i, i) == i) for i in ids}


def test_recall_of_nearest_neighbours(spark):
    _, ids, x = vectors(spark, LARGER)
    got: dict[int, list] = {}
    for r in queries.op8_nearest_neighbours(spark, LARGER).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[i]) for i in asked}
    hit = total = 0
    at = {int(v): k for k, v in enumerate(ids)}
    for i in asked:
        product = x @ x[i]
        product[i] = -np.inf
        want = ids[np.lexsort((ids, -product))[:20]].tolist()
        rows = got[int(ids[i])]
        assert [r.rank for r in rows] == list(range(1, len(want) + 1)) and ids[i] not in [r.vec_id for r in rows]
        assert all(r.score == pytest.approx(float(x[at[r.vec_id]] @ x[i]), rel=1e-12) for r in rows)
        hit, total = hit + len({r.vec_id for r in rows} & set(want)), total + len(want)
    assert hit / total >= 0.9


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op2_toxicity, "toxic", 0.9), (queries.op5_quality, "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    scored = query(spark, LARGER)
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    assert scored.count() == docs.count()
    rows = scored.where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where(F.col(label).isNotNull()).select("score", "predicted", F.col(label).alias("y")).toPandas()
    assert len(rows) > 300 and ((rows["score"] >= 0.7).astype(int) == rows["predicted"]).all()
    rank = rows["score"].rank()
    ones = rows["y"] == 1
    area = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert area >= least


def test_base_score(spark):
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    count: Counter = Counter()
    for i, w in docs:
        if fold(i, 10) != 0:
            count.update([*w, None])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in queries.op6_lm_scoring(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, w in docs:
        tokens, r = [*w, None], got[i]
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(tokens), sum(t in count for t in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        done = corpus_pipeline.C.stored(f(spark, docs, SF), "tested")
        out.append((docs, done))
        docs = done
    return out


def test_pipeline_quality(spark, stages):
    docs, kept = stages[0]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None and fold(r.doc_id, 4) != 2}
    rows = docs.collect()

    def row(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return quality.statistics(raw, np.array([0, len(raw)]))[0]

    x = {i: row(r.text) for i, r in enumerate(rows)}
    seen = [i for i, r in enumerate(rows) if r.doc_id in label]
    model = quality.Discriminant.fit(np.stack([x[i] for i in seen]), np.array([label[rows[i].doc_id] for i in seen]))
    want = Counter(r for i, r in enumerate(rows) if model.score(x[i][None])[0] >= 0.7)
    assert Counter(kept.collect()) == want and 0 < kept.count() < docs.count()


def test_pipeline_dedup(stages):
    docs, kept = stages[1]
    rows = docs.collect()
    component = brute([(r.doc_id, r.text) for r in rows], 5)
    assert Counter(kept.collect()) == Counter(r for r in rows if component[r.doc_id][1] == r.doc_id)


def test_pipeline_secrets(stages):
    docs, done = stages[2]
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in done.collect()}
    found = {r.doc_id: [x.value for x in r.findings] for r in secrets.scan(docs).collect()}
    assert before.keys() == after.keys() and any(found.values())
    for i, r in before.items():
        text = r.text
        for v in sorted(set(found[i]), key=lambda v: (-len(v), v)):
            text = text.replace(v, "[REDACTED]")
        assert after[i].text == text and after[i].n_chars == len(text)
        assert (after[i].lang, after[i].source) == (r.lang, r.source)
        assert not re.search(r'(?i)(token|secret|api_?key)\w* ?[=:] ?"[0-9a-f]{32,}"', text)


def test_pipeline_mixing(spark, stages):
    docs, mixed = stages[3]
    names = sorted(queries.TARGETS)
    rates = mixing.rates(docs, queries.labelled_languages(docs, spark.read.parquet(f"{SF}/labels.parquet")), queries.TARGETS).collect()
    n, p = np.array([r.n_tokens for r in rates], float), np.array([list(r.p) for r in rates])
    want = np.array([queries.TARGETS[d] for d in names]) / sum(queries.TARGETS.values()) * n.sum()
    mass, r = n @ p, np.ones(len(n))
    for _ in range(500):
        r = np.maximum(0, r - (p @ (((n * r) @ p - want) / mass) + 1e-4 * (r - 1)) / (1 + 1e-4))
    assert np.allclose(r, [x.rate for x in rates], atol=1e-3)
    assert np.allclose((n * r) @ p, want, rtol=0.01)
    assert all(abs(x.copies - x.rate) < 1 for x in rates)
    copies = {x.doc_id: x.copies for x in rates}
    got = Counter(mixed.collect())
    assert got == Counter({r: copies[r.doc_id] for r in docs.collect() if copies[r.doc_id]})


def test_pipeline_tokens(stages):
    docs, done = stages[4]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(f.read(), P.PATTERN).rank, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = np.array(other.encode_ordinary(r.text or ""), "<u4")
        want[(r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in done.collect()) == want
