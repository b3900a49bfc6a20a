"""Tables and text files around the catalog, and the writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.sampling import shuffle_rows


def split_products(rows: DataFrame) -> DataFrame:
    """``(app, products)`` from ``(app, label, targets)``; rows of unknown applications are skipped, last row wins."""
    known = rows.where(F.col("app") != "?")
    return known.groupBy("app").agg(F.max_by(F.split("targets", ";"), "pos").alias("products"))


def read_products(spark: SparkSession, path: str, apps: Sequence[str] | None = None) -> DataFrame:
    """Product table: application, label, products separated by semicolons; no header."""
    rows = spark.read.csv(path, schema="app string, label string, targets string")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    if apps is not None:
        rows = rows.where(F.col("app").isin(list(apps)))
    return split_products(rows)


def apps_for_target(products: DataFrame, target: str) -> DataFrame:
    """Applications for one product."""
    return products.where(F.array_contains("products", target.lower())).select("app")


def literal_list(text: str | F.Column) -> F.Column:
    """Array of a list written as ``['a', "b"]``."""
    column = F.col(text) if isinstance(text, str) else text
    return F.from_json(column, "array<string>", {"allowSingleQuotes": "true"})


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(app_display_name, aliases)`` of a CSV table with an index column and a literal list."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select("app_display_name", literal_list("aliases").alias("aliases"))


def read_templates(spark: SparkSession, pattern: str) -> DataFrame:
    """``(type, file, template)`` of few-shot template files; the type is the number before the suffix."""
    files = spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("template")
    )
    return files.select(F.regexp_extract("file", r"_(\d+)\.txt$", 1).cast("int").alias("type"), "file", "template")


def write_catalog(df: DataFrame, path: str) -> None:
    """One directory per application."""
    df.repartition("app").write.mode("overwrite").partitionBy("app").parquet(path)


def write_samples(df: DataFrame, path: str, seed: str = "0") -> None:
    """Samples in a seeded random order."""
    shuffle_rows(df, f"{seed}/shuffle", ["type", "commands", "utterances"]).write.mode("overwrite").parquet(path)


def write_eval(df: DataFrame, path: str) -> None:
    """CSV whose fields may hold line breaks and quotes."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def read_eval(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"')


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], encoder: str, reload: bool = False
) -> DataFrame:
    """Table at ``path``, built when it is absent or a reload is asked for. A table of another encoder is refused."""
    marker = f"{path.rstrip('/')}.encoder"
    known = None
    if not reload:
        known = _read_marker(spark, marker)
    if known is None:
        build().write.mode("overwrite").parquet(path)
        meta = spark.createDataFrame([(json.dumps({"encoder": encoder}),)], "value string")
        meta.write.mode("overwrite").text(marker)
    elif known.lower() != encoder.lower():
        raise ValueError(f"table {path} was built with encoder {known}, not {encoder}")
    return spark.read.parquet(path)


def _read_marker(spark: SparkSession, marker: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(marker).first()
    except AnalysisException:
        return None
    return json.loads(row["value"])["encoder"] if row else None
