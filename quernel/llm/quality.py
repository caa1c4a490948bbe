"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Every text becomes a row of statistics on an unbounded scale. Each class has a mean and a covariance that is shrunk
towards the pooled one (lam) and then towards a multiple of the identity (gamma). A text's score comes from the
difference of the classes' log densities, each a Mahalanobis distance by a cached Cholesky factor; a logistic map,
fitted on the labelled sample, turns the difference into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .common import U64

STATISTICS = ("size", "words", "word_length", "word_spread", "upper", "digits", "marks", "odd_marks", "wide", "lines", "pipes", "distinct_words", "top_word", "distinct_pairs", "odd_ends", "repeated_lines", "sentence_ends")

_CLASSES = np.zeros((256, 6))
_CLASSES[65:91, 0] = 1
_CLASSES[48:58, 1] = 1
_CLASSES[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63], 2] = 1
_CLASSES[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126], 3] = 1
_CLASSES[128:, 4] = 1
_CLASSES[124, 5] = 1
_ODD = _CLASSES[:, 3] + _CLASSES[:, 5] > 0
_ODD[33] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(values: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's values: how many are distinct, and how often the commonest one stands."""
    n = len(bound) - 1
    some, top = np.zeros(n), np.zeros(n)
    for i in range(n):
        v = np.sort(values[bound[i] : bound[i + 1]])
        if len(v):
            cut = np.concatenate(([0], np.flatnonzero(v[1:] != v[:-1]) + 1, [len(v)]))
            some[i], top[i] = len(cut) - 1, np.diff(cut).max()
    return some, top


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x STATISTICS, transformed: logs of sizes, smoothed logits of shares."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    byte = np.stack([np.bincount(raw[off[i] : off[i + 1]], minlength=256) for i in range(n)]) @ _CLASSES
    start, end, doc = C.spans(raw, off)
    bound, length = C.row_bounds(doc, n), (end - start).astype(float)
    sums = C.prefix_sums(raw)
    word = C.span_hashes(sums, start, end)
    words = np.diff(bound).astype(float)
    total = lambda x: np.bincount(doc, x, n)
    mean = total(length) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(total(length**2) / np.maximum(words, 1) - mean**2, 0))
    distinct, top = _distinct(word, bound)
    # a pair stands at its first word; that of a text's last word reaches into the next text and is left out
    pair = C.mix(word[:-1] * U64(3) + word[1:]) if len(word) else word
    pairs, _ = _distinct(pair[(doc[1:] == doc[:-1])] if len(word) else pair, np.concatenate(([0], np.cumsum(np.maximum(np.diff(bound) - 1, 0)))))
    ends = raw[end - 1] if len(end) else raw[:0]
    ls, le, ldoc = C.spans(raw, off, _LINE)
    lbound = C.row_bounds(ldoc, n)
    line, _ = _distinct(C.span_hashes(sums, ls, le), lbound)
    lines = np.diff(lbound).astype(float)
    logit = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread),
        *(logit(byte[:, k], size) for k in range(5)), np.log1p(lines), logit(byte[:, 5], size),
        logit(distinct, words), logit(top, words), logit(pairs, np.maximum(words - 1, pairs)), logit(total(_ODD[ends]), words), logit(lines - line, lines), logit(total(_STOP[ends]), words),
    ])


@dataclass
class Discriminant:
    """A fitted model; scores rows of statistics."""

    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    logs: list[float]  # log determinants
    slope: float = 1.0
    offset: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, lam: float = 0.3, gamma: float = 0.05) -> Discriminant | float:
        """With one class or none labelled, a constant score: the share of ones, or 1/2."""
        if len(y) == 0 or len(set(y.tolist())) < 2:
            return float(y.mean()) if len(y) else 0.5
        shift, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.clip((x - shift) / scale, -8, 8)
        groups = [z[y == k] for k in (0, 1)]
        means = [g.mean(0) for g in groups]
        own = [(g - m).T @ (g - m) for g, m in zip(groups, means, strict=True)]
        pooled, p = sum(own) / len(z), z.shape[1]
        factors, logs = [], []
        for g, s in zip(groups, own, strict=True):
            c = (1 - lam) * s / max(len(g), 1) + lam * pooled
            c = (1 - gamma) * c + gamma * max(np.trace(c) / p, 1e-6) * np.eye(p)
            root = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(root))
            logs.append(2 * float(np.log(np.diag(root)).sum()))
        model = cls(shift, scale, means, factors, logs)
        d = model.difference(x)
        a, b = 1 / max(float(d.std()), 1e-6), 0.0
        for _ in range(50):  # Newton steps of the logistic map, with a little ridge
            q = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
            w = q * (1 - q) + 1e-9
            grad = np.array([((q - y) * d).sum() + 1e-2 * a, (q - y).sum() + 1e-2 * b])
            hess = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-2]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-8:
                break
        model.slope, model.offset = max(a, 1e-6), b
        return model

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.shift) / self.scale, -8, 8)
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * s for m, f, s in zip(self.means, self.factors, self.logs, strict=True)]
        return np.clip(logs[1] - logs[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def with_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, sample: int = 20_000, score_col: str = "quality_score") -> DataFrame:
    """docs with a column score_col (0 to 1).

    labels has (id_col, label_col); rows with a null in either, and those of the held-out fold (crc32 of the id's text
    modulo folds is held), are never learned from. Up to `sample` labelled ids, by hash, fit the model, each by one of its rows.
    A null or empty text gets the score of its statistics, those of no text. Without labels the score is 1/2. Rows
    may repeat; an empty table gives an empty result; a column of that name that docs has is replaced.
    """
    docs = docs.drop(score_col)
    seen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").where(C.fold("doc_id", folds) != held)
    seen = seen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so its broadcast is bounded
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(seen), "doc_id").select("y", "text", "doc_id")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(1)):
                x = statistics(raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(2).slice(i, j - i)], ["y", "x", "id"])

    fitted = texts.mapInArrow(listed, f"y int, x array<double>, id {dict(docs.dtypes)[id_col]}").groupBy("id").agg(F.min(F.struct("y", "x")).alias("r"))
    fitted = fitted.orderBy("id").select("r.y", "r.x").toPandas()
    model = Discriminant.fit(np.stack(fitted["x"].to_numpy()) if len(fitted) else np.zeros((0, len(STATISTICS))), fitted["y"].to_numpy())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in C.text_chunks(batch.column(at)):
                s = np.full(j - i, model) if isinstance(model, float) else model.score(statistics(raw, off))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(s)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.7, **more: object) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; see with_quality. Other columns of docs are not read."""
    out = with_quality(docs.select(id_col, text_col), labels, id_col, text_col, folds=folds, held=held, **more)
    score = F.col("quality_score")
    return out.select(F.col(id_col).alias("doc_id"), F.coalesce(C.fold(id_col, folds) == held, F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
