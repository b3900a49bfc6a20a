"""Catalog JSON files, one document per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.catalog import explode_apps, explode_objects, quarantine_listings, quarantine_schemas


def _path_part(from_end: int) -> Column:
    """Part of the file path counted from its end, unescaped and without the suffix."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    raw = F.replace(F.try_element_at(parts, F.lit(-from_end)), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(raw), r"\.json$", "")


def read_apps(spark: SparkSession, path: str, apps: Sequence[str] | None = None) -> DataFrame:
    """``(app, pos, record)`` of an application map or list."""
    docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    return explode_apps(docs, apps)


def read_listings(spark: SparkSession, directory: str, apps: Sequence[str] | None = None) -> DataFrame:
    """Raw object listings ``(app, doc)``, one file per application."""
    files = spark.read.option("pathGlobFilter", "*.json").text(directory, wholetext=True)
    docs = files.select(_path_part(1).alias("app"), F.try_parse_json("value").alias("doc"))
    return docs.where(F.col("app").isin(list(apps))) if apps is not None else docs


def read_objects(spark: SparkSession, directory: str, apps: Sequence[str] | None = None) -> DataFrame:
    """``(app, object, pos, summary)`` of all good listings."""
    good, _ = quarantine_listings(read_listings(spark, directory, apps))
    return explode_objects(good)


def read_schemas(spark: SparkSession, directory: str, apps: Sequence[str] | None = None) -> DataFrame:
    """Good object schemas ``(app, object, doc)``, one file per object in a directory per application."""
    found = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    files = found.text(directory, wholetext=True)
    docs = files.select(
        _path_part(2).alias("app"), _path_part(1).alias("object"), F.try_parse_json("value").alias("doc")
    )
    docs = docs.where(F.col("app").isin(list(apps))) if apps is not None else docs
    good, _ = quarantine_schemas(docs)
    return good


def list_available(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of the JSON files that match a path pattern; the content is not read."""
    files = spark.read.format("binaryFile").load(pattern).select(_path_part(1).alias("name"))
    return files.distinct()


def skipped_apps(records: DataFrame, listings: DataFrame) -> DataFrame:
    """Applications without a listing."""
    return records.select("app").distinct().join(listings.select("app").distinct(), "app", "left_anti")
