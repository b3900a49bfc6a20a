"""Utterance and program pairs of eight types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.fuzzy import partial_ratio
from corvane.functions.sampling import below_sql, choice, unit
from corvane.functions.text import (
    capitalize,
    command_part,
    is_trigger,
    render_template,
    rstrip_chars,
    trigger_phrase,
    word_count,
)
from corvane.operators.lemma import Lemmatiser, lemmatise_first
from corvane.operators.sampling import (
    draw_descriptions,
    group_table,
    number_draws,
    sampled_pairs,
    sampled_triples,
    shuffle_rows,
)
from corvane.operators.skew import cut_lineage, first_row, tiled_pairs
from corvane.vocab import FUZZY_THRESHOLD, PER_TRIGGER_APP

# --- Descriptions ------------------------------------------------------------------------------------


NAMES = ["app", "object", "op", "app_display_name", "object_display_name"]


def description_array(seed: str | None) -> Column:
    """Array of (source, description) of a command: 1 its description, 2 its display name, 3 the template with names,
    4 the template with display names. With a seed, half of the templates are filled with lower-cased names."""

    def filled(source: int, app: str, obj: str) -> Column:
        lowered = "false" if seed is None else below_sql(0.5, seed, "command", str(source))
        return render_template("op", app, obj, lowered)

    values = [
        F.col("description"),
        F.col("operation_display_name"),
        filled(3, "app", "object"),
        filled(4, "app_display_name", "object_display_name"),
    ]
    return F.array(*[F.struct(F.lit(i).alias("source"), v.alias("description")) for i, v in enumerate(values, 1)])


def stack_descriptions(commands: DataFrame, seed: str | None = "caps") -> DataFrame:
    """Up to four descriptions per command, one row each."""
    rows = commands.select("command", *NAMES, F.explode(description_array(seed)).alias("t"))
    return rows.select("command", F.col("t.source").alias("source"), F.col("t.description").alias("description"), *NAMES)


def with_parts(df: DataFrame) -> DataFrame:
    """Application, object and one-element application list of a command."""
    return df.withColumns(
        {
            "app": command_part(F.col("command"), 1),
            "object": command_part(F.col("command"), 2),
            "app_list": F.array(command_part(F.col("command"), 1)),
        }
    )


def min_words(df: DataFrame, column: str = "description", n: int = 2) -> DataFrame:
    """Texts of at least ``n`` words; blank and missing texts go as well."""
    return df.where(word_count(F.col(column)) >= n)


def with_display_names(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """Attach the display names of application and object to rows that have a command."""
    names = commands.select("command", "app_display_name", "object_display_name")
    return rows.join(names, "command", "left")


def merge_app_lists(*lists: str) -> Column:
    """Application list of a sample made of several parts."""
    return F.concat(*lists)


def complete_commands(commands: DataFrame) -> DataFrame:
    return commands.na.drop(
        subset=["command", "description", "app_display_name", "object_display_name", "operation_display_name"]
    )


def utterances(commands: DataFrame, seed: str | None = "caps", words: int = 2) -> DataFrame:
    """Descriptions of all complete commands, with the columns the samplers use."""
    rows = min_words(stack_descriptions(complete_commands(commands), seed), n=words)
    return rows.withColumn("app_list", F.array("app"))


def packed_utterances(commands: DataFrame, seed: str | None = "caps", words: int = 2) -> DataFrame:
    """The same with one row per command and its descriptions as the array ``texts``; commands without any are gone."""
    kept = F.filter(description_array(seed), lambda t: word_count(t["description"]) >= words)
    rows = complete_commands(commands).select("command", *NAMES, kept.alias("texts"))
    return rows.where(F.size("texts") > 0)


def mentions_app(rows: DataFrame, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """Fuzzy score of the application name in the description, and whether it passes the threshold."""
    name, text = F.lower(command_part(F.col("command"), 1)), F.lower(F.col("description"))
    usable = (F.trim(F.col("command")) != "") & (F.trim(F.col("description")) != "")
    scored = rows.withColumn("app_score", partial_ratio(name, text))
    flag = F.coalesce(usable, F.lit(False)) & F.coalesce(F.col("app_score") > threshold, F.lit(False))
    return scored.withColumn("mentions", flag)


# --- Samples -------------------------------------------------------------------------------------------
#
# A sample type works on ``Draws``: the drawn descriptions of all its streams, numbered within their application.

STREAMS = {1: ["1"], 2: ["2"], 3: ["3/pair", "3/third"], 4: ["4/pair", "4/third"], 5: ["5"]}


@dataclass(frozen=True)
class Draws:
    """Numbered draws ``(stream, role, app, idx, ...)`` and the table of their applications."""

    rows: DataFrame
    apps: DataFrame
    seed: str


def draw(packed: DataFrame, verbs: Lemmatiser, seed: str, types: Sequence[int]) -> Draws:
    """Draws for the given sample types. Both tables are small against the catalog times the samples that refer to
    them, and are kept, so that no sample repeats the work."""
    streams = [s for t in types for s in STREAMS.get(t, [])]
    parts = []
    if streams:
        drawn = draw_descriptions(packed, seed, streams)
        role = F.when(
            F.col("stream") == "5", F.when(F.col("op") == "RETRIEVEALL", "trigger").when(F.col("op") == "CREATE", "action")
        ).otherwise(F.when(is_trigger(F.col("command")), "trigger").otherwise("action"))
        parts.append(lemmatise_first(drawn.withColumn("role", role), "description", "verb_text", verbs))
    if 6 in types:
        objects = packed_objects(packed).withColumns(
            {
                "stream": F.lit("6"),
                "role": F.lit("object"),
                "command": F.col("objects"),
                "source": F.lit(0),
                "op": F.lit(None).cast("string"),
                "description": F.lit(None).cast("string"),
                "verb_text": F.lit(None).cast("string"),
            }
        )
        parts.append(objects.drop("objects"))
    columns = ["stream", "role", "app", "command", "source", "object", "app_display_name", "object_display_name", "description", "verb_text"]
    rows = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).where(F.col("role").isNotNull())
    numbered = cut_lineage(number_draws(rows, "app"))
    return Draws(numbered, cut_lineage(group_table(numbered, "app")), seed)


def packed_objects(packed: DataFrame) -> DataFrame:
    """Distinct objects with the display names of their first command."""
    names = first_row(
        packed.select("app", "object", "app_display_name", "object_display_name", "command"), ["app", "object"], [F.col("command")]
    )
    return names.select(
        F.concat_ws(".", "app", "object").alias("objects"), "app", "object", "app_display_name", "object_display_name"
    )


def samples_type1(draws: Draws) -> DataFrame:
    """Single command."""
    rows = draws.rows.where(F.col("stream") == "1")
    return rows.select(
        F.col("description").alias("utterances"),
        F.col("command").alias("commands"),
        F.array("app").alias("app_list"),
        F.lit(1).alias("type"),
    )


def _pairs(draws: Draws, stream: str, roles: tuple[str, str] = ("trigger", "action")) -> DataFrame:
    columns = ["command", "description", "verb_text", "object", "app_display_name", "object_display_name"]
    return sampled_pairs(draws.rows, draws.apps, "app", stream, roles, f"{draws.seed}/{stream}", columns)


def _opening() -> Column:
    return F.concat(trigger_phrase("description_t"), F.lit(", "), rstrip_chars(F.col("verb_text_a"), "."))


def samples_type2(draws: Draws) -> DataFrame:
    """Trigger, then action: one per pair of applications."""
    return _pairs(draws, "2").select(
        _opening().alias("utterances"),
        F.concat_ws("\n", "command_t", "command_a").alias("commands"),
        F.array("app_t", "app_a").alias("app_list"),
        F.lit(2).alias("type"),
    )


def _triples(draws: Draws, number: int, cap: int | None) -> DataFrame:
    streams = (f"{number}/pair", f"{number}/third")
    columns = ["command", "description", "verb_text"]
    return sampled_triples(
        draws.rows, draws.apps, "app", streams, ("trigger", "action"), f"{draws.seed}/{number}", cap, columns
    )


def samples_type3(draws: Draws, cap: int | None = PER_TRIGGER_APP) -> DataFrame:
    """Trigger, then two actions; at most ``cap`` per trigger application."""
    return _triples(draws, 3, cap).select(
        F.concat(rstrip_chars(_opening(), "."), F.lit(" and "), F.col("verb_text_b")).alias("utterances"),
        F.concat_ws("\n", "command_t", "command_a", "command_b").alias("commands"),
        F.array("app_t", "app_a", "app_b").alias("app_list"),
        F.lit(3).alias("type"),
    )


def if_else_text(u: Column, condition: str) -> Column:
    """One of three phrasings of a conditional flow."""
    trigger = trigger_phrase("description_t")
    low = {s: rstrip_chars(F.lower(F.col(f"description_{s}")), ".") for s in ("a", "b")}
    verb = {s: rstrip_chars(F.col(f"verb_text_{s}"), ".") for s in ("a", "b")}
    if_last = F.concat(trigger, F.lit(", "), verb["a"], F.lit(f" if {condition}, else "), verb["b"])
    action_first = F.concat(
        rstrip_chars(capitalize(F.col("description_a")), "."),
        F.lit(" "),
        F.lower(trigger),
        F.lit(f" if {condition}, else "),
        low["b"],
    )
    if_first = F.concat(F.lit(f"If {condition}, "), F.lower(trigger), F.lit(" "), low["a"], F.lit(", else "), low["b"])
    return choice(u, [if_last, action_first, if_first], [1 / 3, 2 / 3])


def samples_type4(draws: Draws, condition: str = "CONDITION", cap: int | None = PER_TRIGGER_APP) -> DataFrame:
    """Trigger, then one action or another."""
    u = unit(f"{draws.seed}/4/text", "command_t", "command_a", "command_b")
    program = F.concat(
        F.col("command_t"),
        F.lit(f"\nif {condition.replace(' ', '_')}:\n\t"),
        F.col("command_a"),
        F.lit("\nelse:\n\t"),
        F.col("command_b"),
    )
    return _triples(draws, 4, cap).select(
        if_else_text(u, condition).alias("utterances"),
        program.alias("commands"),
        F.array("app_t", "app_a", "app_b").alias("app_list"),
        F.lit(4).alias("type"),
    )


def samples_type5(draws: Draws, nouns: Lemmatiser) -> DataFrame:
    """For each object retrieved from one application, create one in another."""
    rows = nouns.add(_pairs(draws, "5"), F.lower("object_t"), "noun")
    text = F.concat(
        F.lit("For each "), F.col("app_t"), F.lit(" "), F.col("noun"), F.lit(", "), rstrip_chars(F.col("verb_text_a"), ".")
    )
    program = F.concat(F.lit("for "), F.col("noun"), F.lit(" in "), F.col("command_t"), F.lit(":\n\t"), F.col("command_a"))
    return rows.select(
        text.alias("utterances"),
        program.alias("commands"),
        F.array("app_t", "app_a").alias("app_list"),
        F.lit(5).alias("type"),
    )


def plural(name: Column) -> Column:
    """Lower-cased name with exactly one plural s."""
    return F.concat(F.lower(rstrip_chars(name, "s")), F.lit("s"))


def samples_type6(draws: Draws, same_app: bool = True) -> DataFrame:
    """Keep new objects of one application in step with those of another (an application may meet itself)."""
    rows = _pairs(draws, "6", ("object", "object"))
    rows = rows if same_app else rows.where(F.col("app_t") != F.col("app_a"))
    text = F.concat(
        F.lit("Sync new "),
        F.col("app_display_name_t"),
        F.lit(" "),
        plural(F.col("object_display_name_t")),
        F.lit(" with "),
        F.col("app_display_name_a"),
        F.lit(" "),
        plural(F.col("object_display_name_a")),
    )
    program = F.concat(
        F.col("command_t"), F.lit(".CREATED\n"), F.col("command_t"), F.lit(".RETRIEVEALL\n"), F.col("command_a"), F.lit(".CREATE")
    )
    return rows.select(
        text.alias("utterances"),
        program.alias("commands"),
        F.array("app_t", "app_a").alias("app_list"),
        F.lit(6).alias("type"),
    )


def same_object_pairs(objects: DataFrame) -> DataFrame:
    """Ordered pairs of objects with the same lower-cased name in two applications."""
    rows = objects.withColumn("bo", F.lower("object"))
    return tiled_pairs(rows, "bo", ["app"], F.col("app_a") != F.col("app_b"))


def _transfer(pairs: DataFrame, types: Sequence[int]) -> DataFrame:
    names = F.concat(
        plural(F.col("object_display_name_a")),
        F.lit(" from "),
        F.col("app_display_name_a"),
        F.lit(" to "),
        F.col("app_display_name_b"),
    )
    loop = F.concat(
        F.lit("for "), F.lower("object_a"), F.lit(" in "), F.col("objects_a"), F.lit(".RETRIEVEALL:\n\t"), F.col("objects_b"), F.lit(".CREATE")
    )
    forms = {
        7: (F.concat(F.lit("Move "), names), F.concat(loop, F.lit("\n"), F.col("objects_a"), F.lit(".DELETEALL"))),
        8: (F.concat(F.lit("Copy "), names), loop),
    }
    variants = F.array(
        *[F.struct(forms[t][0].alias("u"), forms[t][1].alias("c"), F.lit(t).alias("type")) for t in types]
    )
    rows = pairs.select(F.array("app_a", "app_b").alias("app_list"), F.explode(variants).alias("v"))
    return rows.select(F.col("v.u").alias("utterances"), F.col("v.c").alias("commands"), "app_list", F.col("v.type").alias("type"))


def samples_type7(objects: DataFrame) -> DataFrame:
    """Move objects from one application to another."""
    return _transfer(same_object_pairs(objects), [7])


def samples_type8(objects: DataFrame) -> DataFrame:
    """Copy objects from one application to another."""
    return _transfer(same_object_pairs(objects), [8])


def sample_corpus(
    commands: DataFrame,
    verbs: Lemmatiser,
    nouns: Lemmatiser,
    seed: str = "0",
    types: Sequence[int] = tuple(range(1, 9)),
    cap: int | None = PER_TRIGGER_APP,
    words: int = 2,
) -> DataFrame:
    """All requested sample types in one frame ``(utterances, commands, app_list, type)``.

    ``cap`` bounds the triples of a trigger application (None: all of them), ``words`` is the least length of a text.
    """
    packed = packed_utterances(commands, f"{seed}/caps", words)
    parts = []
    if any(t <= 6 for t in types):
        draws = draw(packed, verbs, seed, types)
        builders = {
            1: samples_type1,
            2: samples_type2,
            3: lambda d: samples_type3(d, cap),
            4: lambda d: samples_type4(d, cap=cap),
            5: lambda d: samples_type5(d, nouns),
            6: samples_type6,
        }
        parts = [builders[t](draws) for t in types if t in builders]
    transfer = [t for t in types if t in (7, 8)]
    if transfer:
        parts.append(_transfer(same_object_pairs(packed_objects(packed)), transfer))
    return reduce(DataFrame.unionByName, parts)


def shuffled_corpus(corpus: DataFrame, seed: str = "0") -> DataFrame:
    return shuffle_rows(corpus, seed + "/shuffle", ["type", "commands", "utterances"])
