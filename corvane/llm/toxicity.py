"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The log-count ratio of every hash bucket comes from all labelled texts: counts in numpy where the rows are read, summed
in Spark; the summed table has at most ``2**bits`` rows a class. A feature is the bucket's share of the text's n-grams
times its ratio. A logistic classifier on these features is fitted on the driver to a bounded sample of labelled rows:
at most ``SAMPLE`` of each class, those with the smallest digest of their id. Scoring multiplies ratio and weight into
one table of ``2**bits`` numbers, which is broadcast; a slice of texts is scored at once.

Cases: labels are joined on the id (a null id has none); an id with several labels counts as 1 if one of them is 1; a
null label is no label; a null text counts as empty, and an empty text gets the score of the bias alone; with labels of
one class only, or none, every score is 0; repeated rows are scored alike, and of rows that share an id the smallest text
is the sampled one; a text of any length is one step of its own; a score at the threshold is toxic; an empty table gives
an empty result; other columns pass through as ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import code_points, map_rows, ngram_buckets, runs_of, span_sums
from corvane.llm.langid import count_ngrams

BITS = 18
ORDERS = (3, 4, 5)
SAMPLE = 1000
INFORMATIVE = 0.2  # buckets with a smaller log-count ratio have the ratio 0 and are no feature
PSEUDO = 100.0
FLOOR = 60  # a shorter text counts as of so many n-grams, so that one n-gram alone decides nothing
TOXIC_SHARE = 0.25
BROADCAST_LABELS = 4_000_000  # rows of (id, label), about 100 MB at most; a longer table is joined by a shuffle
THRESHOLD = 0.7


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(id, text, label) of the documents with a label."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(known, "id")


def _sample(rows: DataFrame, orders: Sequence[int], features: np.ndarray, sample: int) -> list:
    """Sparse counts of the features in the sampled texts, of both classes, on the driver."""
    bits = len(features).bit_length() - 1
    shared = rows.sparkSession.sparkContext.broadcast(features)
    digest = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    chosen = rows.select(digest.alias("digest"), "id", "label").distinct()
    picked = [chosen.where(F.col("label") == k).orderBy("digest", "id").limit(sample) for k in (0, 1)]
    ids = [r.id for p in picked for r in p.select("id").collect()]
    few = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min(F.struct("text", "label")).alias("r")).select("id", "r.*")

    def run(batch):
        out = {"buckets": [], "counts": [], "n": []}
        for t in batch["text"]:
            points, offsets = code_points([t.lower()])
            h = np.concatenate([ngram_buckets(points, o, bits) for o in orders])
            u, c = np.unique(h[shared.value[h]], return_counts=True)
            out["buckets"].append(u.astype(np.int32).tobytes())
            out["counts"].append(c.astype(np.int32).tobytes())
            out["n"].append(len(h))
        return out

    kinds = "buckets binary, counts binary, n bigint"
    return map_rows(few, run, {"text": F.col("text")}, kinds, F.struct("id", "label")).orderBy("row.id").collect()


def _logistic(starts, buckets, values, y, size: int, rounds: int = 120, rate: float = 0.1, ridge: float = 1e-6):
    """Weights and bias of a logistic classifier by full-batch Adam; the classes share the weight as ``TOXIC_SHARE`` says."""
    used, column = np.unique(buckets, return_inverse=True)
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    share = np.where(y == 1, TOXIC_SHARE / max(1, (y == 1).sum()), (1 - TOXIC_SHARE) / max(1, (y == 0).sum()))
    w, b = np.ones(len(used)), 0.0
    theta = np.append(w, b)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(row, values * theta[column], minlength=len(y)) + theta[-1]
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(column, values * error[row], minlength=len(used)) + ridge * (theta[:-1] - 1), error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights = np.ones(size)  # a bucket that the sample lacks keeps the plain naive Bayes weight
    weights[used] = theta[:-1]
    return weights, float(theta[-1])


def fit(rows: DataFrame, orders: Sequence[int] = ORDERS, bits: int = BITS, sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Weight of each bucket (ratio times classifier weight) and bias, from ``labelled`` rows; None without two classes."""
    counts = count_ngrams(rows, F.col("text"), F.col("label"), orders, bits).toArrow()
    label, bucket, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("label", "bucket", "n"))
    if not {"0", "1"} <= set(label):
        return None
    tables = []
    for k in ("1", "0"):
        table = np.zeros(1 << bits)
        table[bucket[label == k]] = n[label == k]
        tables.append(table)
    # Pseudo-counts at the pooled rate: a bucket that says little has a ratio near 0.
    toxic, clean = (t + PSEUDO * t.sum() / (tables[0].sum() + tables[1].sum()) for t in tables)
    ratio = np.log(toxic / clean) - np.log(tables[0].sum() / tables[1].sum())
    ratio[np.abs(ratio) < INFORMATIVE] = 0.0
    picked = _sample(rows, orders, ratio != 0, sample)
    buckets = np.concatenate([np.frombuffer(r.buckets, np.int32) for r in picked])
    sizes = np.array([len(r.buckets) // 4 for r in picked])
    shares = np.concatenate([np.frombuffer(r.counts, np.int32) / np.float32(max(FLOOR, r.n)) for r in picked])
    y = np.array([r["row"]["label"] for r in picked])
    scale = 100.0
    weights, bias = _logistic(np.append(0, np.cumsum(sizes)), buckets, shares * (ratio[buckets] * scale).astype(np.float32), y, 1 << bits)
    return (weights * ratio * scale).astype(np.float32), bias


def score(
    df: DataFrame, text: Column | str, model: tuple[np.ndarray, float] | None, orders: Sequence[int] = ORDERS, keep: Column | None = None
) -> DataFrame:
    """``row`` and ``score`` from 0 to 1, higher where the label 1 is likelier."""
    bits = 0 if model is None else len(model[0]).bit_length() - 1
    bias = 0.0 if model is None else model[1]
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else model[0])

    def run(batch):
        if shared.value is None:
            return {"score": [0.0] * len(batch["text"])}
        texts = [(t or "").lower() for t in batch["text"]]
        out: list[float] = []
        for a, b in runs_of(texts):
            points, offsets = code_points(texts[a:b])
            total, n = np.zeros(b - a), np.zeros(b - a)
            for order in orders:
                h = ngram_buckets(points, order, bits)
                total += span_sums(shared.value[h], offsets, order)
                n += np.maximum(0, np.diff(offsets) - order + 1)
            out += (1 / (1 + np.exp(-np.clip(total / np.maximum(n, FLOOR) + bias, -30, 30)))).tolist()
        return {"score": out}

    return map_rows(df, run, {"text": text}, "score double", keep)
