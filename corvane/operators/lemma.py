"""Dictionary lemmatiser: words are looked up, by the forms that inflection rules give, in a table of dictionary words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import first_word, rest_words, words
from corvane.operators.skew import salted_join
from corvane.vocab import NOUN_RULES, NOUNS, VERB_RULES, VERBS

BROADCAST_WORDS = 200_000
Entries = Sequence | DataFrame


class Lemmatiser:
    """Surface form to dictionary form for one part of speech.

    ``lemmas`` is a table (its first column) or a list of dictionary words, ``exceptions`` a table or a list of (surface,
    lemma). A word is an exception, or one of the dictionary words that the rules (suffix of the surface, suffix of the
    dictionary form) make of it, the shortest one winning; unknown words stay as they are. A dictionary of at most
    ``BROADCAST_WORDS`` words is turned into all its surface forms and sent to every task. Beyond that the candidates
    of each distinct word are joined to the dictionary, and the lemmas are handed back by a join that spreads hot words.
    """

    def __init__(self, spark: SparkSession, lemmas: Entries, rules: Sequence[tuple[str, str]], exceptions: Entries = (), most: int = BROADCAST_WORDS):
        size = sum(x.limit(most + 1).count() if isinstance(x, DataFrame) else len(x) for x in (lemmas, exceptions))
        if not isinstance(lemmas, DataFrame):
            lemmas = spark.createDataFrame([(w,) for w in lemmas], "lemma string")
        if not isinstance(exceptions, DataFrame):
            exceptions = spark.createDataFrame([tuple(e) for e in exceptions], "surface string, lemma string")
        self.rules = list(rules)
        self.lemmas = lemmas.select(F.lower(F.col(lemmas.columns[0])).alias("lemma")).where("lemma <> ''").distinct()
        self.exceptions = exceptions.toDF("surface", "lemma")
        self.forms = F.broadcast(self._all_forms()) if size <= most else None

    def _best(self, found: DataFrame, by: str) -> DataFrame:
        best = F.min(F.struct("rank", F.length("lemma").alias("len"), "lemma"))["lemma"]
        return found.groupBy(by).agg(best.alias("lemma"))

    def _all_forms(self) -> DataFrame:
        """(surface, lemma) of everything that the rules derive from the dictionary."""
        derived = [
            f"CASE WHEN endswith(lemma, '{end}') THEN concat(left(lemma, length(lemma) - {len(end)}), '{surface}') END"
            for surface, end in self.rules
        ]
        forms = self.lemmas.selectExpr(f"explode(array_compact(array(lemma, {', '.join(derived)}))) AS surface", "lemma", "1 AS rank")
        return self._best(forms.unionByName(self.exceptions.withColumn("rank", F.lit(0))), "surface")

    def _lookup(self, distinct: DataFrame) -> DataFrame:
        """(surface, lemma) of the distinct words that are exceptions or have a candidate in the dictionary."""
        made = [
            f"CASE WHEN endswith(surface, '{end}') THEN concat(left(surface, length(surface) - {len(end)}), '{lemma}') END"
            for end, lemma in self.rules
        ]
        candidates = distinct.selectExpr("surface", f"explode(array_distinct(array_compact(array(surface, {', '.join(made)})))) AS lemma")
        known = candidates.join(self.lemmas, "lemma").select("surface", "lemma", F.lit(1).alias("rank"))
        special = distinct.join(self.exceptions, "surface").select("surface", "lemma", F.lit(0).alias("rank"))
        return self._best(known.unionByName(special), "surface")

    def add(self, df: DataFrame, word: Column, out: str) -> DataFrame:
        """Add the dictionary form of a word column."""
        named = df.withColumn("__word", word)
        if self.forms is not None:
            table = self.forms.select(F.col("surface").alias("__surface"), F.col("lemma").alias("__lemma"))
            joined = named.join(table, F.col("__word") == F.col("__surface"), "left")
            return joined.withColumn(out, F.coalesce("__lemma", "__word")).drop("__word", "__surface", "__lemma")
        keyed = named.withColumn("__surface", F.coalesce("__word", F.lit("")))
        distinct = keyed.select(F.col("__surface").alias("surface")).distinct()
        lemmas = distinct.join(self._lookup(distinct), "surface", "left").select(F.col("surface").alias("__surface"), F.col("lemma").alias("__lemma"))
        joined = salted_join(keyed, lemmas, ["__surface"], df.columns)
        return joined.withColumn(out, F.coalesce("__lemma", "__word")).drop("__word", "__surface", "__lemma")


def verb_lemmatiser(spark: SparkSession, lemmas: Entries | None = None, exceptions: Entries = ()) -> Lemmatiser:
    """Over the given dictionary; by default a short list of usual words."""
    return Lemmatiser(spark, VERBS if lemmas is None else lemmas, VERB_RULES, exceptions)


def noun_lemmatiser(spark: SparkSession, lemmas: Entries | None = None, exceptions: Entries = ()) -> Lemmatiser:
    return Lemmatiser(spark, NOUNS if lemmas is None else lemmas, NOUN_RULES, exceptions)


def lemmatise_first(df: DataFrame, column: str, out: str, verbs: Lemmatiser) -> DataFrame:
    """Replace the first word of a text by its verb; words end up one space apart."""
    named = verbs.add(df, F.lower(first_word(F.col(column))), "__verb")
    parts = F.size(words(F.col(column)))
    text = F.when(parts > 1, F.concat_ws(" ", "__verb", rest_words(F.col(column)))).otherwise(F.col("__verb"))
    return named.withColumn(out, text).drop("__verb")


def lemmatise_last(df: DataFrame, column: str, out: str, nouns: Lemmatiser) -> DataFrame:
    """Lower-case a name and replace its last word by its singular."""
    parts = words(F.col(column))
    last = F.lower(F.try_element_at(parts, F.lit(-1)))
    named = nouns.add(df, last, "__noun")
    head = F.lower(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    text = F.when(F.size(parts) > 1, F.concat_ws(" ", head, "__noun")).otherwise(F.col("__noun"))
    return named.withColumn(out, text).drop("__noun")
