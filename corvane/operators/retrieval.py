"""Retrieval of corpus documents for request texts, from text to ranked documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.cells import build_cells, search_cells
from corvane.operators.embed import embed_texts
from corvane.operators.knn import knn
from corvane.operators.scoring import RETRIEVED
from corvane.operators.skew import salted_join
from corvane.vocab import DOCUMENT_SEPARATOR


def retrieve(
    test: DataFrame,
    corpus: DataFrame,
    k: int = RETRIEVED,
    text: str = "utterances",
    encoder: str | Callable = "hash",
    dim: int = 256,
    search: str = "exact",
) -> DataFrame:
    """Rows of ``test`` with the ``k`` documents nearest to their text: ``rank, path, description, document, distance``.

    ``corpus`` is ``(path, description, embedding)`` with one row a path, embedded by the same encoder. Each distinct text
    is encoded and searched once, by its digest, and its hits are handed to all rows that have it; ``search`` is exact
    or by ``cells``. Rows with a null or empty text have no documents. Ties go to the smaller path.
    """
    asked = test.where(F.length(text) > 0).withColumn("__text", F.md5(text))
    distinct = asked.groupBy("__text").agg(F.first(text).alias("__asked"))
    queries = embed_texts(distinct, "__asked", encoder, "query_vec", dim).select(F.col("__text").alias("query_id"), "query_vec")
    items = corpus.select(F.col("path").alias("item_id"), F.col("embedding").alias("item_vec"))
    if search == "cells":
        hits = search_cells(build_cells(items), queries, k)
    elif search == "exact":
        hits = knn(queries, items, k)
    else:
        raise ValueError(f"unknown search {search}")
    document = F.concat("path", F.lit(DOCUMENT_SEPARATOR), F.coalesce("description", F.lit("")))
    documents = corpus.select("path", "description", document.alias("document"))
    named = salted_join(hits.withColumnRenamed("item_id", "path"), documents, ["path"], ["query_id", "rank"])
    # One row a text, so that a text that very many rows have is joined like any hot key.
    found = named.groupBy(F.col("query_id").alias("__text")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "path", "description", "document", "distance"))).alias("__hits")
    )
    return salted_join(asked, found, ["__text"], test.columns).select(*[F.col(c) for c in test.columns], F.inline("__hits"))
