"""A catalog as a set of tables, from files or from DataFrames of JSON records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import catalog as c
from corvane.operators import embed, evalsets, generation
from corvane.operators.lemma import Entries, noun_lemmatiser, verb_lemmatiser
from corvane.operators.skew import configure, cut_lineage
from corvane.sources import catalog_files as files
from corvane.sources.tables import read_products
from corvane.vocab import PER_TRIGGER_APP


@dataclass(frozen=True)
class Catalog:
    """Tables ``apps``, ``objects``, ``operations`` and ``orphans`` and the views over them."""

    apps: DataFrame
    objects: DataFrame
    operations: DataFrame
    orphans: DataFrame | None = None

    @classmethod
    def from_records(
        cls,
        records: DataFrame,
        listings: DataFrame,
        schemas: DataFrame,
        products: DataFrame | None = None,
        patch: bool = True,
        keep: bool = True,
    ) -> Catalog:
        """Catalog of ``(app, pos, record)``, listing documents ``(app, doc)`` and schemas ``(app, object, doc)``.

        Error documents are left out, and so are applications without a good listing. With ``keep`` the parsed objects
        and operations are checkpointed, so that the views over them do not parse the JSON again.
        """
        held = cut_lineage if keep else (lambda df: df)
        good, _ = c.quarantine_listings(listings)
        summaries = c.explode_objects(good)
        schemas, _ = c.quarantine_schemas(schemas)
        apps = held(c.build_apps(records.join(good.select("app"), "app", "left_semi"), products))
        objects, orphans = c.build_objects(summaries, schemas, apps, patch)
        objects = held(objects)
        operations = held(c.build_operations(objects))
        return cls(apps, c.rollup_kinds(objects, operations), operations, orphans)

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        directory: str,
        products: str | None = None,
        apps: Sequence[str] | None = None,
        patch: bool = True,
    ) -> Catalog:
        """Catalog of a directory with ``applications.json``, ``application_objects`` and ``object_schemas``."""
        configure(spark)
        return cls.from_records(
            files.read_apps(spark, f"{directory}/applications.json", apps),
            files.read_listings(spark, f"{directory}/application_objects", apps),
            files.read_schemas(spark, f"{directory}/object_schemas", apps),
            read_products(spark, products) if products else None,
            patch,
        )

    @cached_property
    def commands(self) -> DataFrame:
        return c.commands(self.apps, self.objects, self.operations)

    @cached_property
    def elements(self) -> DataFrame:
        return c.elements(self.apps, self.objects, self.operations)

    @cached_property
    def properties(self) -> DataFrame:
        return c.build_properties(self.operations)

    @cached_property
    def vertices(self) -> DataFrame:
        return c.vertices(self.apps, self.objects, self.operations)

    @cached_property
    def edges(self) -> DataFrame:
        return c.edges(self.objects, self.operations)

    @cached_property
    def descriptions(self) -> DataFrame:
        return embed.descriptions(self.apps, self.objects, self.operations)

    def description_vectors(self, encoder: str | Callable = "hash", dim: int = 256) -> DataFrame:
        """Vectors of all descriptions with the attributes of their elements."""
        rows = self.descriptions.withColumn("vec_id", F.xxhash64("full_name", "description"))
        vectors = embed.embed_distinct(rows, "description", encoder, dim=dim)
        return embed.with_attributes(vectors, self.elements)

    def utterances(self, seed: str | None = "caps") -> DataFrame:
        return generation.utterances(self.commands, seed)

    def sample_corpus(self, seed: str = "0", types: Sequence[int] = tuple(range(1, 9)), **options) -> DataFrame:
        return sample_corpus(self.commands, seed, types, **options)

    def eval_sets(
        self,
        aliases: DataFrame,
        samples: DataFrame,
        censored: DataFrame | None = None,
        records: DataFrame | None = None,
        seed: str = "0",
    ) -> DataFrame:
        """Evaluation sets 1, 2 and 4, and 3 and 6 when their hand-made inputs are given."""
        plain = self.utterances(seed=None)
        parts = {
            1: evalsets.eval_alias(plain, aliases, seed),
            2: evalsets.eval_unique_object(plain, self.commands, seed=seed),
            4: evalsets.eval_composed(samples, self.commands, verb_lemmatiser(samples.sparkSession), seed=seed),
        }
        if censored is not None:
            parts[3] = evalsets.eval_single_object(censored)
        if records is not None:
            parts[6] = records
        return evalsets.eval_sets(parts)


def sample_corpus(
    commands: DataFrame,
    seed: str = "0",
    types: Sequence[int] = tuple(range(1, 9)),
    verbs: Entries | None = None,
    nouns: Entries | None = None,
    cap: int | None = PER_TRIGGER_APP,
    words: int = 2,
) -> DataFrame:
    """Corpus of the chosen sample types for a table of commands.

    ``verbs`` and ``nouns`` are tables of dictionary words (by default short lists), ``cap`` bounds the triples of a
    trigger application (None: all), ``words`` is the least number of words of a text.
    """
    spark = commands.sparkSession
    return generation.sample_corpus(commands, verb_lemmatiser(spark, verbs), noun_lemmatiser(spark, nouns), seed, types, cap, words)
