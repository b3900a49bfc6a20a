"""Completeness checks of catalog records. Every check is a column of warning texts; nothing is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.variant import has_key, has_value, vget


def _warnings(*conditions: tuple[Column, Column | str]) -> Column:
    found = [F.when(cond, F.lit(text) if isinstance(text, str) else text) for cond, text in conditions]
    return F.array_compact(F.array(*found))


def missing(keys: Sequence[str]) -> list[tuple[Column, str]]:
    """Warnings for columns that are null."""
    return [(F.col(k).isNull(), f"no {k}") for k in keys]


def app_warnings(name: str = "app", record: str = "record", dialect: str = "dialect") -> Column:
    own = vget(record, "name")
    nested = F.col(dialect) == "nested"
    return _warnings(
        (F.col(name) != own, F.concat(F.lit("name-conflict: "), F.col(name), F.lit(" | "), own)),
        (~has_key(record, "name"), "no name"),
        (~nested & ~has_key(record, "display_name"), "no display_name"),
        (nested & ~has_key(record, "displayName"), "no displayName"),
        (~has_key(record, "description"), "no description"),
    )


def object_warnings(
    name: str = "object", summary: str = "summary", dialect: str = "dialect", patch: bool = True
) -> Column:
    """Warnings of an object summary; with ``patch`` a missing displayName that ``display.name`` fills says so."""
    own = vget(summary, "name")
    nested = F.col(dialect) == "nested"
    shown, inner = vget(summary, "displayName"), vget(summary, "display.name")
    lacks = F.lit("no displayName")
    if patch:
        lacks = F.when(inner.isNotNull(), F.lit("no displayName, display.name used")).otherwise(lacks)
    differ = F.concat(
        F.lit("label-conflict: "),
        F.coalesce(shown, F.lit("-")),
        F.lit(" | "),
        F.coalesce(inner, F.lit("-")),
    )
    return _warnings(
        (F.col(name) != own, F.concat(F.lit("name-conflict: "), F.col(name), F.lit(" | "), own)),
        (nested & ~shown.eqNullSafe(inner), differ),
        (~has_value(summary, "name"), "no name"),
        (~nested & ~has_value(summary, "display_name"), "no display_name"),
        (nested & ~has_value(summary, "displayName"), lacks),
        (~has_value(summary, "description"), "no description"),
        (nested & ~has_value(summary, "display.description"), "no display.description"),
        (nested & ~has_value(summary, "display.name"), "no display.name"),
    )


def operation_warnings(summary: str = "op_summary", details: str = "op_details", dialect: str = "dialect") -> Column:
    nested = F.col(dialect) == "nested"
    return _warnings(
        (~nested & ~has_value(summary, "description"), "no description"),
        (~nested & ~has_value(summary, "display_name"), "no display_name"),
        (nested & ~has_value(summary, "display.description"), "no display.description"),
        (nested & ~has_value(summary, "display.name"), "no display.name"),
        (nested & F.col(details).isNotNull(), "surplus op_details"),
    )


def with_warnings(df: DataFrame, warnings: Column) -> DataFrame:
    """Only the rows that have warnings, with the list."""
    return df.withColumn("warnings", warnings).where(F.size("warnings") > 0)


def diff_interactions(summary: DataFrame, schema: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interactions that only one of the two sources has."""
    left = summary.select(*keys).distinct().withColumn("in_summary", F.lit(True))
    right = schema.select(*keys).distinct().withColumn("in_schema", F.lit(True))
    joined = left.join(right, list(keys), "full")
    one_sided = F.col("in_summary").isNull() | F.col("in_schema").isNull()
    side = F.when(F.col("in_summary").isNull(), F.lit("schema only")).otherwise(F.lit("summary only"))
    return joined.where(one_sided).select(*keys, side.alias("side"))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return df.na.drop("any")
