"""Evaluation sets built from a catalog, a sample corpus, aliases and hand-written records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.sampling import key_digest, uniform_index
from corvane.functions.text import is_trigger, rest_words, rstrip_chars, trigger_phrase
from corvane.operators.grouping import last_per, single_object_apps, unique_objects
from corvane.operators.lemma import Lemmatiser, lemmatise_first
from corvane.operators.sampling import pick_n, pick_per, resample, resample_per, zip_frames
from corvane.operators.skew import cut_lineage, number_rows
from corvane.vocab import EVAL_ACTIONS_PER_APP, EVAL_COMPOSED, EVAL_OBJECTS


def templated(utt: DataFrame) -> DataFrame:
    """Last template text of each command."""
    rows = utt.select("command", "source", "description", "app", "object", "app_display_name", "object_display_name")
    last = last_per(rows, ["command"], ["source"])
    return last.withColumnRenamed("description", "templated").drop("source")


def with_aliases(utt: DataFrame, aliases: DataFrame, drop_missing: bool = True) -> DataFrame:
    """Templated commands with the alias lists of their application's display name."""
    named = aliases.where(F.size("aliases") >= 1).select("app_display_name", "aliases")
    return templated(utt).join(named, "app_display_name", "inner" if drop_missing else "left")


def eval_alias(utt: DataFrame, aliases: DataFrame, seed: str = "0") -> DataFrame:
    """One utterance per alias, with the alias in place of the application's display name."""
    rows = with_aliases(utt, aliases).withColumn("alias", F.explode("aliases"))
    picked = pick_per(rows.drop("aliases"), ["alias"], seed + "/alias", ["command"])
    text = F.replace("templated", "app_display_name", "alias")
    return picked.select(text.alias("utterances"), F.col("command").alias("commands"))


def eval_unique_object(utt: DataFrame, commands: DataFrame, n: int = EVAL_OBJECTS, seed: str = "0") -> DataFrame:
    """Commands of objects no other application has, without the application's name in the text."""
    pair = ["app_display_name", "object_display_name"]
    unique = unique_objects(commands, *pair)
    per_app = pick_per(unique, ["app_display_name"], seed + "/object", pair)
    chosen = pick_n(per_app, n, seed + "/n", pair)
    rows = commands.select(*pair, "command").join(chosen, pair, "left_semi")
    picked = pick_per(rows, pair, seed + "/command", ["command"])
    texts = templated(utt).select("command", "templated")
    joined = picked.join(texts, "command", "left")
    text = F.replace("templated", F.concat(F.lit(" "), F.col("app_display_name")), F.lit(""))
    return joined.select(text.alias("utterances"), F.col("command").alias("commands"))


def single_object_commands(commands: DataFrame, utt: DataFrame) -> DataFrame:
    """Commands of applications with one object next to all their descriptions."""
    apps = single_object_apps(commands)
    rows = commands.select("app", "object", "command").join(apps, ["app", "object"], "left_semi")
    return rows.join(utt.select("command", "source", "description"), "command", "left")


def eval_single_object(censored: DataFrame, order: str = "source") -> DataFrame:
    """First censored description of each command that is there; null only where all are."""
    filled = F.when(F.col("description_censored").isNotNull(), F.col(order))
    first = censored.groupBy("command").agg(F.min_by("description_censored", filled).alias("utterances"))
    return first.select("utterances", F.col("command").alias("commands"))


def mentions(commands: DataFrame, kind: str) -> DataFrame:
    """Actions or triggers whose description names the application (name or display name, any case)."""
    text = F.lower("description")
    named = text.contains(F.lower("app_display_name")) | text.contains(F.lower("app"))
    wanted = is_trigger(F.col("command")) if kind == "triggers" else ~is_trigger(F.col("command"))
    return commands.where(F.col("description").isNotNull() & named & wanted)


def all_apps_named(samples: DataFrame, sample_type: int = 3) -> DataFrame:
    """Samples of one type whose text holds every name of their application list."""
    every = F.forall("app_list", lambda a: F.col("utterances").contains(a))
    return samples.where((F.col("type") == sample_type) & every)


def eval_composed(
    samples: DataFrame,
    commands: DataFrame,
    verbs: Lemmatiser,
    n: int = EVAL_COMPOSED,
    per_app: int = EVAL_ACTIONS_PER_APP,
    seed: str = "0",
) -> DataFrame:
    """Three-command samples extended by a random action."""
    # Both pools are drawn from by position, which reads them more than once.
    named = cut_lineage(all_apps_named(samples).select("utterances", "commands"))
    base = resample(named, n, seed + "/samples", ["commands", "utterances"])
    actions = lemmatise_first(mentions(commands, "actions"), "description", "action_text", verbs)
    pool = resample_per(
        actions.select("app_display_name", "command", "action_text"),
        "app_display_name",
        per_app,
        seed + "/pool",
        ["command"],
        out="pool_draw",
    )
    extra = resample(cut_lineage(pool), n, seed + "/actions", ["app_display_name", "pool_draw"])
    rows = zip_frames(base.select("draw", "utterances", "commands"), extra.select("draw", "command", "action_text"))
    shorter = rstrip_chars(F.replace("utterances", F.lit(" and "), F.lit(", ")), ".")
    return rows.select(
        F.concat(shorter, F.lit(" and "), F.col("action_text")).alias("utterances"),
        F.concat_ws("\n", "commands", "command").alias("commands"),
    )


def eval_trigger_composed(samples: DataFrame, commands: DataFrame, seed: str = "0") -> DataFrame:
    """Three-command samples preceded by a random trigger (one draw per sample)."""
    base = all_apps_named(samples).select("utterances", "commands")
    triggers = cut_lineage(mentions(commands, "triggers").select("command", "description"))
    numbered = number_rows(triggers, [], key_digest("order", "command"), ties=["command"], out="__idx")
    total = triggers.agg(F.count(F.lit(1)).alias("n")).scalar()
    sized = base.withColumn("__n", total)
    draws = sized.withColumn("__idx", uniform_index("__n", seed + "/trigger", "commands", "utterances"))
    rows = draws.drop("__n").join(numbered, "__idx", "inner")
    opening = trigger_phrase("description", specifies=True)
    return rows.select(
        F.concat(opening, F.lit(" and "), rest_words(F.col("utterances"))).alias("utterances"),
        F.concat_ws("\n", "command", "commands").alias("commands"),
    )


def eval_sets(parts: dict[int, DataFrame]) -> DataFrame:
    """Union of evaluation sets with their type."""
    rows = [df.select("commands", "utterances").withColumn("type", F.lit(t)) for t, df in sorted(parts.items())]
    return reduce(DataFrame.unionByName, rows)
