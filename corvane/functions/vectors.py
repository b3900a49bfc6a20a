"""Vector expressions and the default text encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_WORDS = 1 << 17  # words whose digests a task keeps


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    rows = np.asarray(rows, dtype=np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def hash_words(text: Column) -> Column:
    """Lower-cased words (letters and digits) of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def hash_counts(words: str, dim: int, known: dict[bytes, bytes]) -> np.ndarray:
    """Signed counts of the words (parted by blanks) and pairs of words. ``known`` keeps the digests of words."""
    each = words.encode().split()
    digests = [known.get(w) or known.setdefault(w, md5(w).digest()) for w in each]
    digests += [md5(pair).digest() for pair in map(b" ".join, zip(each, each[1:]))]
    places = np.frombuffer(b"".join(digests), ">u4")[3::4] % np.uint32(2 * dim)
    counts = np.bincount(places, minlength=2 * dim)
    return counts[:dim] - counts[dim:]


def hash_encode(df: DataFrame, text: str, out: str = "embedding", dim: int = 256) -> DataFrame:
    """Signed hashed counts of words and word pairs, scaled to length one. Map-only: words by the JVM, counts by numpy.

    The last 8 hex digits of a token's md5, modulo 2 * dim, are its place, and from ``dim`` on its sign is minus.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            units = []
            for words in batch:
                counts = hash_counts(words, dim, known).astype(np.float64)
                length = np.sqrt((counts * counts).sum())
                units.append((counts * (1.0 / length if length else 1.0)).astype(np.float32))
                if len(known) > KNOWN_WORDS:
                    known.clear()
            yield pd.Series(units, dtype=object)

    return df.withColumn(out, encode(F.array_join(hash_words(F.col(text)), " ")))


def batch_encode(
    df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "embedding", batch: int = 100
) -> DataFrame:
    """Run a caller's batch function over the text column, ``batch`` texts at a time."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    schema = StructType(list(df.schema.fields)).add(out, ArrayType(FloatType()))

    def encode(frames):
        for frame in frames:
            texts = frame[text].tolist()
            vectors: list = []
            for start in range(0, len(texts), batch):
                block = np.asarray(encoder(texts[start : start + batch]), dtype=np.float32)
                vectors.extend(block)
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(encode, schema)
