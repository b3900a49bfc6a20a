"""Group operators. Lists come back in long form, (group, position, value), so that no group has to fit a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.sampling import key_digest
from corvane.functions.text import command_part, rstrip_chars
from corvane.operators.skew import first_row, number_rows, salted_join


def group_list(df: DataFrame, by: Sequence[str], col: str, order: Sequence[str]) -> DataFrame:
    """Members of each group with a position."""
    return number_rows(df.select(*by, col, *order), by, key_digest("list", *order), ties=order, out="position")


def group_set(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Distinct members of each group."""
    return df.select(*by, col).distinct()


def group_concat_lists(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Members of the array column of all rows of a group, one row each."""
    return df.select(*by, F.explode(col).alias(col))


def group_small_list(df: DataFrame, by: Sequence[str], col: str, order: str, limit: int) -> DataFrame:
    """Ordered arrays for groups known to hold at most ``limit`` members; a larger group is an error, not a cut."""
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, col))).alias("__l"))
    checked = F.when(F.size("__l") <= limit, F.col("__l")).otherwise(
        F.raise_error(F.lit(f"group of {col} exceeds {limit} members"))
    )
    return packed.select(*by, F.transform(checked, lambda s: s[col]).alias(col))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_row(df, by, [F.col(c) for c in order])


def last_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_row(df, by, [F.col(c) for c in order], last=True)


def dedupe(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each distinct ``subset``."""
    return first_per(df, subset, order)


def keep_matching(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def single_object_apps(commands: DataFrame) -> DataFrame:
    """Applications with exactly one object. Two running values per application, not a set of objects."""
    spread = commands.groupBy("app").agg(F.min("object").alias("object"), F.max("object").alias("__last"))
    return spread.where(F.col("object") == F.col("__last")).select("app", "object")


def distinct_objects(utterances: DataFrame) -> DataFrame:
    """``(objects, app, object)`` for the distinct first two parts of the commands."""
    path = F.substring_index(F.col("command"), ".", 2)
    rows = utterances.select(path.alias("objects")).distinct()
    return rows.select("objects", command_part(F.col("objects"), 1).alias("app"), command_part(F.col("objects"), -1).alias("object"))


def objects_with_names(utterances: DataFrame) -> DataFrame:
    """Distinct objects with the display names of their first row."""
    names = first_row(
        utterances.select("app", "object", "app_display_name", "object_display_name", "command", "source"),
        ["app", "object"],
        [F.col("command"), F.col("source")],
    )
    return names.select(
        F.concat_ws(".", "app", "object").alias("objects"), "app", "object", "app_display_name", "object_display_name"
    )


def recurring_objects(objects: DataFrame) -> DataFrame:
    """Lower-cased object names found in more than one application."""
    counts = objects.groupBy(F.lower("object").alias("bo")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def folded_name(name: Column) -> Column:
    """Lower-cased name without the plural s."""
    return rstrip_chars(F.lower(name), "s")


def unique_objects(objects: DataFrame, app: str, name: str) -> DataFrame:
    """Objects whose folded name no other (application, object) has: an aggregate, never a comparison of pairs."""
    grouped = objects.select(app, name).distinct().groupBy(folded_name(F.col(name)).alias("folded"))
    counted = grouped.agg(F.count(F.lit(1)).alias("n"), F.min(app).alias(app), F.min(name).alias(name))
    return counted.where(F.col("n") == 1).select(app, name)


def ambiguous_objects(named: DataFrame, app: str, lemma: str) -> DataFrame:
    """``(lemma, n_apps)`` for lemmas that several applications share."""
    pairs = named.select(lemma, app).distinct()
    counts = pairs.groupBy(lemma).agg(F.count(F.lit(1)).alias("n_apps"))
    return counts.where(F.col("n_apps") > 1)


def ambiguity_report(named: DataFrame, app: str, lemma: str) -> DataFrame:
    """Commands behind each ambiguous lemma with their operation, one row per command."""
    found = ambiguous_objects(named, app, lemma)
    rows = named.select(lemma, app, "command").distinct()
    joined = salted_join(rows, found, [lemma], [app, "command"])
    return joined.select(lemma, "n_apps", app, "command", command_part(F.col("command"), -1).alias("method"))


def description_postings(descriptions: DataFrame, text: str, element: str) -> DataFrame:
    """Distinct ``(text_key, element)`` of non-empty texts; the key is the digest of the lower-cased text."""
    rows = descriptions.where(F.length(text) > 0)
    return rows.select(F.md5(F.lower(text)).alias("text_key"), element).distinct()


def description_index(descriptions: DataFrame, text: str, element: str) -> DataFrame:
    """Each distinct lower-cased text once with the number of its elements."""
    lowered = descriptions.where(F.length(text) > 0).select(F.lower(text).alias("text"), element)
    keyed = lowered.withColumn("text_key", F.md5("text"))
    # The text itself never enters the shuffle of the element count, only its digest does.
    counts = keyed.groupBy("text_key").agg(F.min(element).alias("first_element"), F.count_distinct(element).alias("n_elements"))
    return counts


def sorted_list(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    return df.select(*by, col).orderBy(*by, col)
