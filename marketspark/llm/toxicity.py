"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 18
GRAMS = (4, 6)
SAMPLE = 6_000  # labelled texts the classifier learns from at most, half of each label
SEEN = 5  # learning texts an n-gram must be in
ROUNDS = 60
CUT = 0.7


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of the lower-cased whole text."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    seen = np.zeros(BUCKETS, bool)
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            seen[h % np.uint64(BUCKETS)] = True
    return np.flatnonzero(seen)


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    """Weights per bucket (ratio times logistic coefficient) and intercept."""
    y = np.array(labels, float)
    weights = np.zeros(BUCKETS)
    if not len(y) or y.min() == y.max():
        return weights, 3.0 if len(y) and y[0] else -3.0
    rows = [features(t).astype(np.int32) for t in texts]
    count = np.zeros((2, BUCKETS))
    for r, label in zip(rows, labels):
        count[int(label), r] += 1
    p, q = (count[1] + 1) / (y.sum() + 2), (count[0] + 1) / ((1 - y).sum() + 2)
    ratio = np.log(p / q)
    # An n-gram counts if the texts that hold it differ by label by more than chance allows.
    share = count.sum(0) / len(y)
    gap = np.abs(count[1] / y.sum() - count[0] / (1 - y).sum()) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / y.sum() + 1 / (1 - y).sum()))
    use = np.flatnonzero((count.sum(0) >= SEEN) & (gap > 5))
    place = np.full(BUCKETS, -1, np.int32)
    place[use] = np.arange(len(use))
    cols = []
    for k, r in enumerate(rows):
        c = place[r]
        cols.append(c[c >= 0])
        rows[k] = None
    at, flat = np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols)
    x = ratio[use][flat]
    w, b, v, g2, gb = np.zeros(len(use)), 0.0, 0.0, np.full(len(use), 1e-8), 1e-8
    for _ in range(ROUNDS * 5):
        z = np.bincount(at, x * w[flat], len(y)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(flat, x * err[at], len(use)) / len(y) + 1e-4 * w
        g2, gb = g2 + grad**2, gb + err.mean() ** 2
        w, b = w - 0.1 * grad / np.sqrt(g2), b - 0.1 * err.mean() / np.sqrt(gb)
    weights[use] = ratio[use] * w
    return weights, float(b)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled, not held-out documents, picked by the md5 of their id.

    Their ids, bounded by ``sample``, are all that is broadcast; labels that are null are unknown.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample // 2) for k in (0, 1)]
    ids = picked[0].union(picked[1]).toDF("labelled_id", "label")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")
    found = rows.toPandas().sort_values(["doc_id"], kind="stable")
    return fit(found["text"].tolist(), found["label"].tolist())


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``(doc_id, score)`` per row of ``docs``; null text scores as empty text."""
    weights, b = model
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        w = shared.value
        for batch in batches:
            z = np.array([w[features(t)].sum() + b for t in batch["text"]], float)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, learn(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under ``CUT``, scored in one pass that keeps every column."""
    weights, b = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([float(1 / (1 + np.exp(-np.clip(shared.value[features(t)].sum() + b, -30, 30)))) for t in text])

    return docs.where(score("text") < CUT)
