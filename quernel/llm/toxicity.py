"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters: words of a small fixed lexicon of four languages, and patterns (words and word beginnings) that one half of the
   labelled texts proposes. A voter says toxic where its pattern stands; the given label is one more, fallible voter.
2. The label model is a latent class with a tree of correlations: given the class, a voter depends on one other, chosen
   by conditional mutual information, so voters that fire together aren't counted twice. Expectation maximisation
   starts from the number of votes and estimates accuracies (the given label's, too) and correlations on the other half,
   where the proposed voters haven't seen the labels. The posteriors stand in for the labels from here on.
3. A logistic classifier is trained on the posteriors, over the patterns that stand out by them, and scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import U64

#: Fixed lexicon of common insults, in English, German, Spanish and French.
LEXICON = (
    "idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "dumb", "filth", "vermin", "garbage", "ugly", "hate", "kill", "shut", "bastard",
    "dumm", "abschaum", "versager", "arschloch", "wertlos", "widerlich", "drecksau", "trottel", "schwachkopf", "hure",
    "idiota", "escoria", "perdedor", "asqueroso", "basura", "payaso", "gilipollas", "cabron", "imbecil", "puta",
    "idiote", "ordure", "minable", "salaud", "connard", "stupide", "imbécile", "pathétique", "salope", "raclure",
)
#: Bytes of word beginnings that are patterns; 0 is the whole word.
PREFIXES = (0, 4, 5, 6, 7)


def patterns(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern hashes of the texts' words (runs of letters, A-Z lower-cased), and their text numbers."""
    raw = C.LOWER[raw]
    start, end, doc = C.spans(raw, off, C.LETTER)
    sums = C.prefix_sums(raw)
    out, of = [], []
    for k in PREFIXES:
        long = slice(None) if k == 0 else end - start > k
        s, e = start[long], end[long]
        out.append(C.span_hashes(sums, s, s + k if k else e) ^ U64(k))
        of.append(doc[long])
    return np.concatenate(out), np.concatenate(of)


def word_pattern(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(patterns(raw, np.array([0, len(raw)]))[0][:1].view(np.int64)[0])


#: Accuracies that the given label is believed to have at most, where it is 0 and where it is 1.
GOLD = (0.95, 0.9)
#: Rows at a voter's own rate that steady its rate beside its parent's vote.
STEADY = 20


@dataclass
class LabelModel:
    """Latent class with tree-shaped correlations among 0/1 votes."""

    prior: float = 0.5
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 0)))  # P(vote = 1 | class, parent's vote)
    accuracy: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # P(vote = 1 | class)
    gold: np.ndarray = field(default_factory=lambda: np.zeros(2))  # P(given label = class | class)

    @staticmethod
    def tree(votes: np.ndarray, q: np.ndarray, least: float = 1e-4) -> np.ndarray:
        """Each voter's parent (-1: none) in the heaviest tree by mutual information given the class."""
        m = votes.shape[1]
        info = np.zeros((m, m))
        for w in (q, 1 - q):
            total = w.sum() + 1.0
            one = (votes.T @ w + 0.5) / total
            both = ((votes * w[:, None]).T @ votes + 0.25) / total
            for a in (0, 1):
                for b in (0, 1):
                    joint = both if a and b else one[:, None] - both if a else one[None] - both if b else 1 - one[:, None] - one[None] + both
                    joint = np.maximum(joint, 1e-9)
                    info += total / len(votes) * joint * np.log(joint / ((one if a else 1 - one)[:, None] * (one if b else 1 - one)[None]))
        parent, best, of = np.full(m, -1), np.zeros(m), np.full(m, -1)
        left = set(range(m))
        while left:
            j = max(left, key=lambda j: best[j])
            parent[j] = of[j] if best[j] > least else -1
            left.discard(j)
            for k in left:
                if info[j, k] > best[k]:
                    best[k], of[k] = info[j, k], j
        return parent

    @classmethod
    def fit(cls, votes: np.ndarray, gold: np.ndarray, learn: np.ndarray | None = None, rounds: int = 20) -> tuple[LabelModel, np.ndarray]:
        """The model, and each row's posterior of class 1. gold: the given label, 0 or 1. Parameters are estimated on the rows of the mask learn (all by default).

        The first posteriors follow the number of votes. The given label votes with estimated accuracies of at most GOLD: as it
        stands in every row, it would otherwise become the class itself; without it, the class may settle on one language."""
        votes = votes.astype(float)
        learn = np.ones(len(votes), bool) if learn is None or not learn.any() else learn
        many = votes.sum(1)
        q = np.where(many == 0, 0.02, np.where(many == 1, 0.5, 0.98))
        model = cls()
        m = votes.shape[1]
        above = votes
        for t in range(rounds):
            w = q[learn]
            if t % 5 == 0:
                model.parent = cls.tree(votes[learn], w)
                above = np.where(model.parent >= 0, votes[:, np.maximum(model.parent, 0)], 0.0) if m else votes
            model.prior = float((w.sum() + 1) / (len(w) + 2))
            model.table = np.zeros((2, 2, m))
            odds = np.full(len(q), np.log(model.prior / (1 - model.prior)))
            right = [((1 - w) @ (gold[learn] == 0) + 9) / ((1 - w).sum() + 10), (w @ (gold[learn] == 1) + 9) / (w.sum() + 10)]
            model.gold = np.minimum(right, GOLD)
            odds += np.where(gold == 1, np.log(model.gold[1] / (1 - model.gold[0])), np.log((1 - model.gold[1]) / model.gold[0]))
            for y, v in ((1, w), (0, 1 - w)):
                rate = (v @ votes[learn] + 0.1) / (v.sum() + 0.2 + 0.8 * (1 - y))
                for a in (0, 1):  # a rare parent's rows weigh against a few at the voter's own rate
                    on = v[:, None] * (above[learn] == a)
                    model.table[y, a] = ((on * votes[learn]).sum(0) + STEADY * rate) / (on.sum(0) + STEADY)
                p = np.where(above == 1, model.table[y, 1], model.table[y, 0])
                odds += (1 if y else -1) * np.log(np.where(votes == 1, p, 1 - p)).sum(1)
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        w = q[learn]
        model.accuracy = np.stack([((1 - w) @ votes[learn] + 0.1) / ((1 - w).sum() + 1), (w @ votes[learn] + 0.1) / (w.sum() + 0.2)])
        return model, q


def fit_linear(row: np.ndarray, column: np.ndarray, width: int, q: np.ndarray, ridge: float = 2e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic weights of width features and an offset on soft labels, by accelerated gradient steps. Row and column of each feature that is present."""
    n = len(q)
    times = lambda v: np.bincount(row, v[column], n) + v[-1]
    back = lambda u: np.append(np.bincount(column, u[row], width), u.sum())
    v = np.random.default_rng(0).random(width + 1)
    for _ in range(20):
        v = back(times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * float(v @ back(times(v))) / n + ridge)
    w = last = np.zeros(width + 1)
    for t in range(steps):
        y = w + t / (t + 3) * (w - last)
        grad = back(1 / (1 + np.exp(-np.clip(times(y), -30, 30))) - q) / n
        grad[:-1] += ridge * y[:-1]
        last, w = w, y - rate * grad
    return w[:-1], float(w[-1])


def standing_out(rows: DataFrame, weight: str, limit: int) -> list[int]:
    """Patterns of rows (keys) that stand out among those of high weight (0 to 1), the strongest first: the divergence of a
    pattern's share from the share of all rows must be more than chance gives any of so many patterns."""
    total = rows.agg(F.coalesce(F.avg(weight), F.lit(0.0)).alias("share"), F.coalesce(F.sum(F.size("keys")), F.lit(1)).alias("patterns")).first()
    if not 0 < total["share"] < 1:
        return []
    counts = rows.select(weight, F.explode("keys").alias("key")).groupBy("key").agg(F.sum(weight).alias("on"), F.count("*").alias("all"))
    part = lambda x, share: F.when(x > 1e-9, x * F.log(x / (F.col("all") * share))).otherwise(0.0)
    gain = part(F.col("on"), total["share"]) + part(F.col("all") - F.col("on"), 1 - total["share"])
    found = counts.where(F.col("on") > F.col("all") * min(1.0, 3 * total["share"])).withColumn("gain", F.round(gain, 6)).where(F.col("gain") > float(np.log(total["patterns"])))
    return [r.key for r in found.orderBy(F.desc("gain"), "key").limit(limit).select("key").collect()]


def _present(rows: DataFrame, keys: list[int], *more: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows' other columns, and the row and the place among keys of each key that a row holds."""
    at = {k: i for i, k in enumerate(keys)}
    got = rows.select(*more, F.array_intersect("keys", F.array(*[F.lit(k) for k in keys])).alias("keys")).orderBy("id").toPandas()
    many = got["keys"].map(len).to_numpy(int) if len(got) else np.zeros(0, int)
    return got, np.repeat(np.arange(len(got)), many), np.array([at[k] for ks in got["keys"] for k in ks], int)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, sample: int = 20_000, vocabulary: int = 1024, voters: int = 96, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels has (id_col, label_col); rows with a null in either, and those of the held-out fold (crc32 of the id's text
    modulo folds is held), are never learned from. Up to `sample` labelled ids, by hash, propose voters and fit the models; of rows that
    share a labelled id one is learned from. A null or empty text has no pattern and gets the offset's score. Where no text of the
    sample has a vote, the lexicon alone decides. Rows may repeat; an empty table gives an empty result; other columns of docs are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(C.fold("doc_id", folds) != held)
    seen = seen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(1)):
                key, doc = patterns(raw, off)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[new], doc[new]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(pa.array(C.row_bounds(doc, j - i), pa.int32()), pa.array(key.view(np.int64)))], ["id", "y", "keys"])

    rows = texts.join(F.broadcast(seen), "doc_id").select("doc_id", "text", "y").mapInArrow(listed, f"id {kind}, y int, keys array<long>")  # at most `sample` ids
    rows = C.stored(rows.groupBy("id").agg(F.min(F.struct("y", "keys")).alias("r")).select("id", "r.y", "r.keys", (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == 0).alias("proposes")), "patterns")
    lexicon = [word_pattern(w) for w in LEXICON]
    keys = list(dict.fromkeys([*lexicon, *standing_out(rows.where("proposes").withColumn("w", F.col("y").cast("double")), "w", voters)]))
    got, row, column = _present(rows, keys, "id", "y", "proposes")
    if len(row):
        votes = np.zeros((len(got), len(keys)), np.uint8)
        votes[row, column] = 1
        _, posterior = LabelModel.fit(votes, got["y"].to_numpy(), ~got["proposes"].to_numpy(bool))
        told = rows.sparkSession.createDataFrame(pd.DataFrame({"id": got["id"], "q": posterior}), f"id {kind}, q double")
        keys = list(dict.fromkeys([*keys, *standing_out(rows.join(F.broadcast(told), "id"), "q", vocabulary)]))  # at most `sample` rows
        got, row, column = _present(rows, keys, "id")
        weight, offset = fit_linear(row, column, len(keys), posterior)
    else:
        keys = lexicon
        weight, offset = np.full(len(keys), 5.0), -3.0
    keys = np.array(keys, np.int64).view(np.uint64)
    order = np.argsort(keys)
    sorted_keys, weight = keys[order], weight[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(1)):
                key, doc = patterns(raw, off)
                place = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
                hit = sorted_keys[place] == key
                both = np.unique(doc[hit] * len(sorted_keys) + place[hit])
                s = offset + np.bincount(both // len(sorted_keys), weight[both % len(sorted_keys)], j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], ["doc_id", "score"])

    out = texts.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(C.fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
