import re

import pytest

from quernel.llm import minhash

SF = "/root/testdata/sf0.01"


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_components_match_brute_force(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=width).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "  \t\n"), (4, "one two"), (5, "One TWO"), (6, base), (7, base + " x"), (8, base.upper()), (9, "é"), (10, base * 200), (11, base * 200)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, key string, rep int")
    out = minhash.near_duplicates(docs, width=4)
    assert out.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    assert got == brute(rows, 4)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_group_with_links_through_one_text(spark):
    """Texts that are similar to the centre only; the centre isn't the smallest id."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100, " ".join(words))]
    for k in range(12):
        w = list(words)
        for m in range(4):
            w[16 * k + 4 * m] = f"y{k}_{m}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=4).collect()}
    assert got == brute(rows, 4)
