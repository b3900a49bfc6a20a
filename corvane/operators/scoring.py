"""Retrieval and generation scores."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.functions.fuzzy import position_masks
from corvane.functions.text import clean_generation, normalise_label, program_tokens
from corvane.vocab import CLARIFICATION, DOCUMENT_SEPARATOR, PROMPT_LAYOUTS

RETRIEVED = 5  # candidates retrieved per utterance


def split_docs(hits: DataFrame, document: str = "document") -> DataFrame:
    """``path`` and ``description`` of a retrieval document."""
    cut = F.locate(DOCUMENT_SEPARATOR, F.col(document))
    return hits.withColumns(
        {
            "path": F.substring_index(document, DOCUMENT_SEPARATOR, 1),
            "description": F.when(
                cut > 0, F.substring(document, cut + len(DOCUMENT_SEPARATOR), F.length(document))
            ),
        }
    )


def path_in_label(path: Column, label: Column, compat: bool = False) -> Column:
    """Whether a command is one of the words of a program; ``compat`` is satisfied by a substring."""
    if compat:
        return label.contains(path)
    return F.array_contains(F.regexp_extract_all(label, F.lit(r"([\w.\-]+)"), F.lit(1)), path)


def hit_at_k(test: DataFrame, hits: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """``hit`` per test row: is one of the retrieved paths in its label? Rows without hits count as misses."""
    joined = hits.select(key, "path").join(test.select(key, "commands"), key, "inner")
    found = joined.where(path_in_label(F.col("path"), normalise_label(F.col("commands")), compat)).select(key).distinct()
    return test.join(found.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def prompts(test: DataFrame, hits: DataFrame | None, key: str, layout: str, eos: str = "</s>", apps: str = "", k: int = RETRIEVED) -> DataFrame:
    """Prompt text of every test row. The layouts with candidates show the ``k`` best ``hits`` (key, rank, path,
    description)."""
    template = PROMPT_LAYOUTS[layout]
    rows = test
    if "{pairs}" in template or "{paths}" in template:
        line = F.concat(
            F.lit("    "),
            F.concat("description", F.lit(": "), "path") if "{pairs}" in template else F.col("path"),
            F.lit("\n"),
        )
        listed = hits.where(F.col("rank") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("__l"))
        text = F.array_join(F.transform("__l", lambda s: s["line"]), "")
        rows = rows.join(listed.select(key, text.alias("__lines")), key, "left")
        lines = F.coalesce("__lines", F.lit(""))
    else:
        lines = F.lit("")
    filled = template.replace("{eos}", eos).replace("{{apps}}", "{" + apps + "}")
    slots = {"{pairs}": lines, "{paths}": lines, "{u}": F.col("utterances")}
    pieces = [slots.get(p, F.lit(p)) for p in re.split(r"(\{pairs\}|\{paths\}|\{u\})", filled) if p]
    return rows.withColumn("prompt", F.concat(*pieces)).drop("__lines")


def clarification(utterance: Column, app: Column) -> Column:
    """Follow-up that names the application."""
    head, tail = CLARIFICATION.split("{u}")[1].split("{app}")
    return F.concat(utterance, F.lit(head), app, F.lit(tail))


def label_app(commands: Column) -> Column:
    """Application of the first command of a program."""
    return F.substring_index(F.substring_index(commands, ".", 1), " ", -1)


def needs_app(test: DataFrame) -> DataFrame:
    """Test rows whose utterance does not name the application of the label."""
    app = label_app(F.col("commands"))
    return test.withColumn("app", app).where(~F.lower("utterances").contains(F.lower("app")))


def _token_distance(a: Sequence[str], b: Sequence[str]) -> float:
    """Edit distance over the longer length. The differences along a column of the table are two integers (steps up and
    steps down, one bit per token), so that a token of ``b`` costs a few integer operations."""
    m = len(a)
    if not m or not len(b):
        return float(bool(m or len(b)))
    masks, full, last = position_masks(a), (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for token in b:
        same = masks.get(token, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more = down | (full & ~(diagonal | up))
        less = up & diagonal
        distance += bool(more & last) - bool(less & last)
        more, less = (more << 1) | 1, less << 1
        vertical = same | down
        up = full & (less | ~(vertical | more))
        down = full & more & vertical
    return distance / max(m, len(b))


@F.pandas_udf(DoubleType())
def _token_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([None if x is None or y is None else _token_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays over the longer length; equal arrays need no dynamic programme."""
    return F.when(a == b, F.lit(0.0)).otherwise(_token_distance_udf(a, b))


def exact_match(test: DataFrame, distance: bool = False, brackets: bool = True) -> DataFrame:
    """Cleaned generation against the label: ``exact``, and with ``distance`` the normalised token distance.

    ``exact`` is equality of the token arrays, with and without the distance, for programs of any length.
    """
    cleaned = normalise_label(clean_generation(F.col("generations"), brackets))
    rows = test.withColumns({"response": cleaned, "label": normalise_label(F.col("commands"))})
    left, right = program_tokens(F.col("response")), program_tokens(F.col("label"))
    rows = rows.withColumn("exact", F.coalesce(left == right, F.lit(False)))
    return rows.withColumn("distance", token_distance(left, right)) if distance else rows


def report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of rows, exact matches and hits, overall or by group."""
    flags = [c for c in ("exact", "hit") if c in scored.columns]
    sums = [F.sum(F.col(c).cast("bigint")).alias(f"n_{c}") for c in flags]
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def first_correct(rounds: DataFrame, key: str, order: str, exact: str = "exact", generation: str = "generations") -> DataFrame:
    """Per row the first correct generation over its rounds, else the first one."""
    pick = F.min_by(F.struct(generation, exact), F.struct((~F.col(exact)).alias("wrong"), F.col(order).alias("at")))
    return rounds.groupBy(key).agg(pick.alias("r")).select(key, f"r.{generation}", f"r.{exact}")


def evaluate(
    test: DataFrame, generations: DataFrame, hits: DataFrame | None, key: str, by: Sequence[str] = (), compat: bool = False
) -> DataFrame:
    """Report of stored generations ``(key, generations)`` and retrieved paths ``(key, rank, path)`` against a test frame."""
    scored = exact_match(test.join(generations.select(key, "generations"), key, "left"))
    if hits is not None:
        scored = hit_at_k(scored, hits, key, compat)
    return report(scored, by)
