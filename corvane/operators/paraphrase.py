"""Requests for paraphrases and the scores of what came back. The generations themselves are an input table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.fuzzy import partial_ratios
from corvane.functions.text import first_sentence, rstrip_chars
from corvane.vocab import SAMPLE_TYPES


def route_to_template(samples: DataFrame, templates: DataFrame) -> DataFrame:
    """Samples with the few-shot template of their type, null for types that have none.

    Several templates of one type: the last one by file name is used. There are eight types, so the template side has
    at most eight rows.
    """
    known = templates.where(F.col("type").isin(SAMPLE_TYPES))
    last = known.groupBy("type").agg(F.max_by("template", "file").alias("template"))
    return samples.join(F.broadcast(last), "type", "left")


def closed(text: Column) -> Column:
    """Text with exactly one full stop at its end."""
    return F.concat(rstrip_chars(text, "."), F.lit("."))


def request_text(template: Column, utterance: Column) -> Column:
    return F.concat(template, F.lit("\n\nPhrase:\n"), closed(utterance), F.lit("\nParaphrase:\n"))


def paraphrase_requests(samples: DataFrame, templates: DataFrame) -> DataFrame:
    """Request text of every sample whose type has a template."""
    routed = route_to_template(samples, templates)
    return routed.where(F.col("template").isNotNull()).withColumn(
        "request", request_text(F.col("template"), F.col("utterances"))
    )


def accept_generation(generation: Column, utterance: Column) -> Column:
    """First sentence of a generation; a failed (null) one falls back to the utterance."""
    return F.coalesce(first_sentence(generation), closed(utterance))


def score_paraphrases(samples: DataFrame, generations: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """Paraphrase and per-application fuzzy scores; samples without a template keep nulls."""
    routed = route_to_template(samples, templates).join(generations, key, "left")
    treated = F.col("template").isNotNull()
    text = F.when(treated, accept_generation(F.col("generation"), F.col("utterances")))
    scored = routed.withColumn("paraphrased_utterances", text).drop("template", "generation")
    return scored.withColumn("partial_ratios", partial_ratios(F.col("paraphrased_utterances"), F.col("app_list")))
