"""Mixing to target weights: soft domain membership and fitted document rates, in DataFrame functions and MLlib only.

A multinomial logistic model over hashed words, fitted on a bounded sample of a labelled table, gives every document
posteriors p over domains. With n tokens per document, rates r >= 0 minimise

    1/2 sum_k (sum_d r_d n_d p_dk - T_k)^2 / m_k  +  ridge/2 sum_d n_d (r_d - 1)^2,    m_k = sum_d n_d p_dk

by projected gradient steps in the metric n. There the curvature is at most 1 + ridge, so the fixed step is
1 / (1 + ridge). A step needs one aggregation of as many sums as there are domains; the steps' few numbers are kept, and
each document folds them into its own rate, so nothing per document is collected, joined or shuffled.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C


def words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def token_count(text: Column) -> Column:
    """Runs without ASCII white space."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), " ")
    return F.size(F.array_remove(parts, "")).cast("long")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, sample: int, features: int, carry: bool = False) -> DataFrame:
    """(doc_id, n, p): token count, and posteriors in the order of domains; if carry, also the whole row."""
    whole = [F.struct(*docs.columns).alias("row")] if carry else []
    more = ["row"] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("n"), words(F.col(text_col)).alias("words"), *whole)
    seen = labelled.select(F.col("text"), F.col("domain")).where(F.col("domain").isin(domains))
    seen = seen.orderBy(F.xxhash64("text", "domain"), "domain").limit(sample).select("domain", words(F.col("text")).alias("words"))
    steps = [HashingTF(inputCol="words", outputCol="counts", numFeatures=features), Normalizer(inputCol="counts", outputCol="x", p=2.0)]
    for s in steps:
        seen, rows = s.transform(seen), s.transform(rows)
    seen = C.stored(seen.select("domain", "x"), "domain-sample")
    found = [r["domain"] for r in seen.select("domain").distinct().collect()]
    if len(found) < 2:  # nothing to tell apart: the one domain that was seen, or all alike
        return rows.select("doc_id", "n", F.array(*[F.lit(float(d in found) if found else 1 / len(domains)) for d in domains]).alias("p"), *more)
    index = StringIndexer(inputCol="domain", outputCol="y", stringOrderType="alphabetAsc").fit(seen)
    model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-3, maxIter=40, probabilityCol="p").fit(index.transform(seen))
    at = {d: k for k, d in enumerate(index.labels)}
    p = vector_to_array("p")
    return model.transform(rows).select("doc_id", "n", F.array(*[p[at[d]] if d in at else F.lit(0.0) for d in domains]).alias("p"), *more)


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", tokens: float | None = None, ridge: float = 1e-4, tolerance: float = 1e-6, max_steps: int = 60, sample: int = 4000, features: int = 4096, carry: bool = False) -> DataFrame:
    """(doc_id, domain, n_tokens, p, rate, copies) for every row of docs; if carry, also row, a struct of the row's columns.

    labelled has (text, domain), of which up to `sample` rows, by hash, fit the classifier; null and unknown domains
    are left out. targets are relative weights of domains; `tokens` is the wanted total (by default the present one).
    A null or empty text has no tokens and its posterior is the model's for no words. copies is the rate's whole
    part, plus one for a hash of the id below its fraction. An empty table gives an empty result; a target that no
    document carries cannot be met and leaves the rest as near as least squares gets. Other columns aren't read.
    """
    domains = sorted(targets)
    table = C.stored(posteriors(docs, labelled, domains, id_col, text_col, sample, features, carry), "posteriors")
    n, p = F.col("n"), F.col("p")
    sums = lambda r: [F.sum(n * p[k] * r).alias(f"m{k}") for k in range(len(domains))]
    mass = [x or 0.0 for x in table.agg(*sums(F.lit(1.0))).first()]
    total = sum(mass)
    want = [targets[d] / sum(targets.values()) * (tokens if tokens is not None else total) for d in domains]
    step = 1 / (1 + ridge)
    history: list[list[float]] = []

    def rate() -> Column:
        r = F.lit(1.0)
        if not history:
            return r
        steps = F.array(*[F.array(*[F.lit(x) for x in h]) for h in history])
        down = lambda h: sum((p[k] * h[k] for k in range(len(domains))), F.lit(0.0))
        return F.aggregate(steps, r, lambda r, h: F.greatest(F.lit(0.0), r - step * (down(h) + ridge * (r - 1.0))))

    now, before = mass, None
    while total and len(history) < max_steps and (before is None or max(abs(a - b) for a, b in zip(now, before, strict=True)) > tolerance * total):
        history.append([(a - t) / m if m > 0 else 0.0 for a, t, m in zip(now, want, mass, strict=True)])
        now, before = [x or 0.0 for x in table.agg(*sums(rate())).first()], now
    out = table.withColumn("rate", rate())
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    best = F.array_position(p, F.array_max(p)).cast("int")
    return out.select("doc_id", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), F.col("n").alias("n_tokens"), "p", "rate", (F.floor("rate") + (share < F.col("rate") - F.floor("rate")).cast("long")).cast("int").alias("copies"), *(["row"] if carry else []))
