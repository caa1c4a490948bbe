"""Repeated rows, rows without an id, odd widths, and bounds that only save work."""

import numpy as np
import pytest

from quernel.llm import common, minhash, permutation, pigeonhole

TEXT = " ".join(f"w{i}" for i in range(60))


def test_near_duplicates_without_ids_and_repeated(spark):
    rows = [(5, TEXT), (3, TEXT + " x"), (None, TEXT), (None, "alone in the world with some words"), (None, "alone in the world with some words"), (None, None), (7, ""), (7, "other text of its own"), (5, TEXT), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "'a' AS rep", "2 AS many")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows) and all(isinstance(r[3], bool) for r in got)
    assert [r for r in got if r[1] == 56] == [(5, 56, 3, False)] * 2 + [(None, 56, 3, False)]
    assert sorted(r[:1] + r[2:] for r in got if r[0] in (3, 7, 9)) == [(3, 3, True), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert [r for r in got if r[0] is None and r[1] != 56] == [(None, 0, None, True)] + [(None, 3, None, True)] * 2


def test_bit_maps_never_promise_too_much():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 200, 4000)]
    sets += [np.unique(np.concatenate([s[len(s) // 10 :], rng.integers(0, 1 << 63, 1 + len(s) // 10).astype(np.uint64)])) for s in sets]
    maps = minhash.bit_maps(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint64)
    for a, x in zip(sets, maps, strict=True):
        for b, y in zip(sets, maps, strict=True):
            assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("hot", [0, 2, 10_000])
def test_hot_classes_are_joined_alike(spark, hot):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(100)], "id long, key long")
    classes = spark.createDataFrame([(k, 3 * k, f"c{k}") for k in range(4)], "key long, many long, name string")
    got = common.with_class(rows, classes, ["key"], hot=hot)
    assert sorted((r.id, r.name) for r in got.collect()) == [(i, None if i % 7 == 0 or i % 5 == 4 else f"c{i % 5}") for i in range(100)]


def vectors(seed=1, rows=300, width=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, width))
    x[rows // 2 :] = x[: rows - rows // 2] + 0.05 * rng.standard_normal((rows - rows // 2, width))
    return x


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vectors_that_repeat_or_do_not_fit(spark, kind):
    x = vectors().astype(np.float32 if kind == "float" else float).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(0, 40, 2)] + [(3, x[9].tolist())]
    odd = [(1000, [1.0, 2.0]), (1001, None), (1002, []), (1003, [0.0] * 8), (1004, [float("nan")] * 8), (1005, [1.0, None] * 4), (None, x[0].tolist())]
    table = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS key", "'q' AS x", "2 AS many")
    got = pigeonhole.near_duplicates(table).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        if r.vec_id is None or r.vec_id >= 1000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    cosine = np.einsum("ik,jk->ij", m, m) / np.sqrt(np.outer((m**2).sum(1), (m**2).sum(1)))
    near = (cosine >= 0.95) | (m[:, None] == m[None]).all(2)
    np.fill_diagonal(near, False)
    group = ids.copy()
    for _ in range(len(ids)):
        group = np.minimum(group, np.where(near, group[None], 1 << 40).min(1))
    want = sorted(zip(ids.tolist(), near.sum(1).tolist(), group.tolist(), (ids == group).tolist(), strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id < 1000) == want


def test_queries_that_repeat(spark):
    x = vectors(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame([*rows, (1000, [1.0]), (None, x[3].tolist()), (1001, None)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([rows[0], rows[0], rows[5], (1000, [1.0]), (None, x[3].tolist())], "vec_id long, embedding array<double>")
    got = permutation.search(table, asked, k=10).orderBy("query_id", "rank").collect()
    for q in (0, 5):
        score = x @ x[q]
        best = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-score[i], i))[:10]
        assert [(r.rank, r.vec_id) for r in got if r.query_id == q] == list(enumerate(best, 1))
    assert {r.query_id for r in got} == {0, 5}


@pytest.mark.parametrize("items", [10, 1 << 22])
def test_large_buckets_give_the_same(spark, monkeypatch, items):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    base = rng.choice(words, 80).tolist()
    rows = []
    for i in range(120):
        w = list(base)
        w[int(rng.integers(0, 80))] = f"u{i}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(rng.choice(words, 60))) for i in range(40)] + [(300 + i, rows[3][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(minhash.near_duplicates(docs).collect())
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(minhash, "HOT_ITEMS", items)
    assert sorted(minhash.near_duplicates(docs).collect()) == want and len({r.component_id for r in want}) < 100
