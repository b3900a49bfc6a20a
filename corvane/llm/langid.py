"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in numpy where the rows are read and sums (language, bucket) counts in Spark; only the summed
table, at most ``2**bits`` rows for each of at most ``MAX_LANGUAGES`` languages, reaches the driver, which makes the
matrix of log-probabilities. It is broadcast (its size is bounded by the same two numbers) and scores a slice of texts at
once: the n-grams of all texts are row numbers of the matrix, and sums between text boundaries are the log-likelihoods.

Cases: rows with a null text or language are not learned from; a text that is null or has no letter is ``und`` with
score 0; equal likelihoods go to the language that sorts first; without any learned language everything is ``und``;
more than ``MAX_LANGUAGES`` languages raise an error rather than dropping some.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import code_points, map_rows, ngram_buckets, runs_of, span_sums, within

BITS = 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.1
MAX_LANGUAGES = 256
UNKNOWN = "und"


def count_ngrams(df: DataFrame, text: Column, label: Column, orders: Sequence[int], bits: int) -> DataFrame:
    """(label, bucket, n): how often the n-grams of each hash bucket occur in the texts of each label."""
    import pyarrow as pa

    rows = df.select(text.alias("text"), label.cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_label: dict[str, list[str]] = {}
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_label.setdefault(c, []).append(t.lower())
            for c, texts in by_label.items():
                total = counts.setdefault(c, np.zeros(1 << bits, np.int64))
                for a, b in runs_of(texts, 1 << 20):  # each slice adds whole tables
                    points, offsets = code_points(texts[a:b])
                    for order in orders:
                        h = ngram_buckets(points, order, bits)
                        total += np.bincount(h[within(offsets, order, len(h))], minlength=1 << bits)
        for c, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
                names=["label", "bucket", "n"],
            )

    counted = rows.mapInArrow(run, "label string, bucket int, n bigint")
    return counted.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: Column, lang: Column, orders: Sequence[int] = ORDERS, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Sorted languages, and the matrix (bucket, language) of log-probabilities."""
    counts = count_ngrams(df, text, lang, orders, bits)
    counts = counts.groupBy("label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    rows = counts.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r.label)
    matrix = np.full((1 << bits, len(rows)), SMOOTHING)
    for k, r in enumerate(rows):
        cells = np.array(r.cells, np.int64).reshape(-1, 2)
        matrix[cells[:, 0], k] += cells[:, 1]
    return [r.label for r in rows], np.log(matrix / matrix.sum(axis=0))


def predict(
    df: DataFrame,
    text: Column,
    model: tuple[list[str], np.ndarray],
    orders: Sequence[int] = ORDERS,
    keep: Column | None = None,
) -> DataFrame:
    """``row``, ``lang_pred`` and ``score``, the posterior of the predicted language under equal priors."""
    langs, matrix = model
    bits = int(matrix.shape[0]).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix.T.astype(np.float32)))

    def run(batch):
        tables = shared.value
        texts = [(t or "").lower() for t in batch["text"]]
        out = {"lang_pred": [], "score": []}
        for a, b in runs_of(texts):
            points, offsets = code_points(texts[a:b])
            like = np.zeros((len(langs), b - a))
            for order in orders:
                h = ngram_buckets(points, order, bits)
                for k in range(len(langs)):
                    like[k] += span_sums(tables[k][h], offsets, order)
            if langs:
                best = like.argmax(axis=0)
                score = 1 / np.exp(like - like.max(axis=0)).sum(axis=0)
            for i, t in enumerate(texts[a:b]):
                known = bool(langs) and any(map(str.isalpha, t))
                out["lang_pred"].append(langs[best[i]] if known else UNKNOWN)
                out["score"].append(float(score[i]) if known else 0.0)
        return out

    return map_rows(df, run, {"text": text}, "lang_pred string, score double", keep)
