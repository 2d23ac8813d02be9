"""Quality rules: text statistics, and an isolation forest over them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketspark.llm.common import table  # noqa: F401
from marketspark.sources.snapshot import materialize

SAMPLE = 8_192  # good labelled rows the trees grow from at most
TREES = 200
TREE_ROWS = 256
DEPTH = 12
FALSE_ALARMS = 0.002  # share of good labelled rows the threshold may reject
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"
FEATURES = ("symbol_rate", "upper_rate", "mark_rate", "dup_rate", "repeat_rate")  # each in 0 to 1


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    n = len(ws)
    blanks = sum(text.count(c) for c in "\x20\t\n\v\f\r")
    lines = [x for x in data.split(b"\n") if x.split()]
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in ws), np.int64, n)
        two = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1].astype(np.int64)
        _, at, count = np.unique(two[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = count[at] > 1
        hit = np.zeros(n, bool)
        for j in range(3):
            hit[j : n - 2 + j] |= again
        repeat = int(hit.sum())
    upper = len(re.findall("[A-Z]", text))
    marks = len(re.findall(r"[!-/:-@\[-`{-~]", text))
    return n, len(text) - blanks, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, len(lines), upper, marks


def document_statistics(docs: DataFrame) -> DataFrame:
    """STATS per row; null text counts as empty."""

    def run(batches):
        names = [c.split()[0] for c in STATS.split(", ")]
        for batch in batches:
            rows = [statistics(t) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names[1:], dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, STATS)


def _features(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.least(F.lit(1.0), F.col(a) / F.greatest(F.lit(1), F.col(b)))
    return df.withColumns(
        {
            "symbol_rate": per("n_symbols", "n_words"), "upper_rate": per("n_upper", "word_chars"), "mark_rate": per("n_marks", "n_words"),
            "dup_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def _expected(n: int) -> float:
    """Mean depth at which a random binary tree isolates one of ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, seed: int = 7) -> list[list[tuple]]:
    """Trees of nodes ``(feature, split, left, right)``; a leaf has feature -1 and its depth.

    Splits are drawn over the box of the node, the unit cube at first, and not over its rows' range:
    rows unlike any the tree grew from then end early, in boxes that hold none.
    """
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(TREES if len(rows) else 0):
        nodes: list[tuple] = []

        def node(x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, depth + _expected(len(x)), 0, 0))
            if depth == DEPTH or len(x) < 2:
                return at
            f = int(rng.integers(x.shape[1]))
            split = float(rng.uniform(low[f], high[f]))
            under, over = high.copy(), low.copy()
            under[f] = over[f] = split
            left = x[:, f] < split
            a = node(x[left], low, under, depth + 1)
            nodes[at] = (f, split, a, node(x[~left], over, high, depth + 1))
            return at

        node(rows[rng.choice(len(rows), min(TREE_ROWS, len(rows)), replace=False)], np.zeros(rows.shape[1]), np.ones(rows.shape[1]), 0)
        forest.append(nodes)
    return forest


def anomaly(forest: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """0 to 1 per row: higher for shorter mean paths; 0 without a forest."""
    if not forest or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for nodes in forest:
        feature, value, left, right = (np.array([n[k] for n in nodes]) for k in range(4))
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            inner = feature[at] >= 0
            go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] < value[at], left[at], right[at])
            at = np.where(inner, go, at)
        total += value[at]
    return 2 ** (-(total / len(forest)) / _expected(TREE_ROWS))


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics, ``base_failed``, ``anomaly`` and ``kept`` per row of ``docs``.

    The forest grows from at most ``sample`` rows labelled good that pass the base rules, so that
    what strays from good text is isolated early. The threshold is read from the scores of all
    labelled rows, counted by thousandths: the least one that rejects no more than FALSE_ALARMS of
    the good ones. Without labels the base rules decide alone. Null ids are never labelled.
    """
    stats = materialize(_features(document_statistics(docs)), "quality-stats")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = materialize(stats.where("not base_failed").join(known, "doc_id").select("doc_id", "quality", *FEATURES), "quality-labelled")
    good = marked.where("quality = 1").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(sample).select(*FEATURES).toPandas()
    forest = docs.sparkSession.sparkContext.broadcast(grow(good.to_numpy(float)))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(anomaly(forest.value, np.column_stack([c.to_numpy(float) for c in columns])))

    counts = marked.where("quality = 1").groupBy(F.ceil(score(*FEATURES) * 1000).alias("bin")).count().orderBy(F.desc("bin")).collect()
    allowed, cut = FALSE_ALARMS * sum(r["count"] for r in counts), 1000
    for r in counts:
        allowed -= r["count"]
        if allowed < 0:
            cut = r["bin"]
            break
    return stats.withColumn("anomaly", score(*FEATURES)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") * 1000 <= F.lit(cut)))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )
