"""Descriptions of elements and their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.variant import vget
from corvane.functions.vectors import batch_encode, dot, hash_encode, norm
from corvane.operators.skew import salted_join
from corvane.vocab import DOCUMENT_SEPARATOR, TAG_APP, TAG_OBJECT, TAG_OPERATION


def _texts(*columns: Column) -> Column:
    """Distinct non-empty texts."""
    return F.filter(F.array_distinct(F.array_compact(F.array(*columns))), lambda t: t != "")


def descriptions(apps: DataFrame, objects: DataFrame, operations: DataFrame) -> DataFrame:
    """``(full_name, typename, description)``: name, display name and description of every element, and for objects of
    the nested dialect their inner display texts too."""
    nested = F.col("dialect") == "nested"
    inner = [F.when(nested, vget("summary", path)) for path in ("display.name", "display.description")]
    three = ["display_name", "description"]

    def part(df: DataFrame, tag: str, full: Column, texts: Column) -> DataFrame:
        return df.select(full.alias("full_name"), F.lit(tag).alias("typename"), F.explode(texts).alias("description"))

    columns = [F.col(c) for c in three]
    return (
        part(apps, TAG_APP, F.col("app"), _texts(F.col("app"), *columns))
        .unionByName(part(objects, TAG_OBJECT, F.concat_ws("/", "app", "object"), _texts(F.col("object"), *columns, *inner)))
        .unionByName(part(operations, TAG_OPERATION, F.concat_ws("/", "app", "object", "op"), _texts(F.col("op"), *columns)))
    )


def embed_texts(df: DataFrame, text: str, encoder: str | Callable = "hash", out: str = "embedding", dim: int = 256) -> DataFrame:
    """Add a vector per row: the built-in hash encoder or a batch function of the caller."""
    if encoder == "hash":
        return hash_encode(df, text, out, dim)
    return batch_encode(df, text, encoder, out)


def embed_distinct(
    rows: DataFrame, text: str, encoder: str | Callable = "hash", out: str = "embedding", dim: int = 256
) -> DataFrame:
    """Encode each distinct lower-cased text once and hand the vector to all its rows.

    The fan-out joins on a digest, so that the texts themselves are shuffled once.
    """
    keyed = rows.where(F.length(text) > 0).withColumn("__key", F.md5(F.lower(text)))
    distinct = keyed.groupBy("__key").agg(F.first(F.lower(text)).alias("__text"))
    vectors = embed_texts(distinct, "__text", encoder, out, dim).select("__key", out)
    return salted_join(keyed, vectors, ["__key"], [c for c in rows.columns]).drop("__key")


def text_cosine(
    df: DataFrame, a: str, b: str, encoder: str | Callable = "hash", out: str = "similarity", dim: int = 256
) -> DataFrame:
    """Cosine similarity of the texts in two columns, each encoded on its own; 0 where a text has no vector."""
    both = embed_texts(embed_texts(df, a, encoder, "__a", dim), b, encoder, "__b", dim)
    lengths = norm(F.col("__a")) * norm(F.col("__b"))
    return both.withColumn(out, F.when(lengths > 0, dot(F.col("__a"), F.col("__b")) / lengths).otherwise(F.lit(0.0))).drop("__a", "__b")


def with_attributes(vectors: DataFrame, all_elements: DataFrame) -> DataFrame:
    """Vectors of descriptions with element id, parent id, kinds and products; ids of rows by digest."""
    attributes = all_elements.select("full_name", "element_id", "parent_id", "op_types", "products")
    return vectors.join(attributes, "full_name", "inner")


def corpus(commands: DataFrame, encoder: str | Callable = "hash", dim: int = 256) -> DataFrame:
    """``(path, description, app_display_name, embedding)`` of every command; the text encoded is the whole document."""
    rows = commands.select(F.col("command").alias("path"), "description", "app_display_name")
    documents = rows.withColumn("__doc", F.concat("path", F.lit(DOCUMENT_SEPARATOR), F.coalesce("description", F.lit(""))))
    return embed_texts(documents, "__doc", encoder, dim=dim).drop("__doc")
