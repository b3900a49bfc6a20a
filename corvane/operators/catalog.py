"""Catalog tables (applications, objects, operations, properties) from JSON records, and views over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import operation_kind
from corvane.functions.variant import explode_variant, has_key, is_array, resolve_path, vget
from corvane.operators.skew import cut_lineage, number_rows
from corvane.vocab import (
    ACTIONS,
    DUMMY_APPS,
    KIND_PATCHES,
    KINDS,
    NESTED_VERSION,
    TAG_APP,
    TAG_OBJECT,
    TAG_OPERATION,
    TRIGGERS,
)

# --- Records out of documents --------------------------------------------------------------------


def explode_apps(docs: DataFrame, apps: Sequence[str] | None = None) -> DataFrame:
    """``(app, pos, record)`` from documents ``(doc)`` that hold a name-to-record map or a list of records."""
    rows = explode_variant(docs.select("doc"), "doc").select(
        F.coalesce("key", vget("value", "name")).alias("app"), "pos", F.col("value").alias("record")
    )
    rows = rows.where(~F.col("app").isin(DUMMY_APPS))
    return rows.where(F.col("app").isin(list(apps))) if apps is not None else rows


def quarantine_listings(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object listings split into good ones (a list, or a map with ``objects`` and no ``errors``) and error documents."""
    good = is_array("doc") | (has_key("doc", "objects") & ~has_key("doc", "errors"))
    good = F.coalesce(good, F.lit(False))
    return docs.where(good), docs.where(~good)


def quarantine_schemas(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Object schemas split into good ones and error documents (``errors`` and nothing else of use)."""
    bad = has_key("doc", "errors") & ~has_key("doc", "interactions") & ~has_key("doc", "properties")
    bad = F.coalesce(bad | F.col("doc").isNull(), F.lit(True))
    return docs.where(~bad), docs.where(bad)


def explode_objects(listings: DataFrame) -> DataFrame:
    """``(app, object, pos, summary)`` from good listings ``(app, doc)``."""
    members = listings.withColumn("members", F.coalesce(vget("doc", "objects", "variant"), F.col("doc")))
    rows = explode_variant(members.select("app", "members"), "members")
    return rows.select("app", vget("value", "name").alias("object"), "pos", F.col("value").alias("summary"))


def flatten_catalog(docs: DataFrame) -> DataFrame:
    """Corpus rows of a nested ``app > object > operation > {command_description, app_display_name}`` document."""
    apps = explode_variant(docs.select("doc"), "doc").select(F.col("key").alias("app"), F.col("value").alias("v1"))
    objects = explode_variant(apps, "v1").select("app", F.col("key").alias("object"), F.col("value").alias("v2"))
    ops = explode_variant(objects, "v2")
    return ops.select(
        F.concat_ws(".", "app", "object", "key").alias("path"),
        vget("value", "command_description").alias("description"),
        vget("value", "app_display_name").alias("app_display_name"),
    )


# --- Silver tables ---------------------------------------------------------------------------------


def dialect_of(record: str = "record") -> Column:
    """``nested`` or ``flat``; null when neither display key is present."""
    return (
        F.when(vget(record, "version") == NESTED_VERSION, F.lit("nested"))
        .when(has_key(record, "display_name"), F.lit("flat"))
        .when(has_key(record, "displayName"), F.lit("nested"))
    )


def normalise(records: DataFrame) -> DataFrame:
    """``(app, dialect, display_name, description)`` and the raw record, whatever the dialect."""
    converted = vget("record", "version") == NESTED_VERSION
    named = F.when(
        (F.col("dialect") == "nested") & ~F.coalesce(converted, F.lit(False)), vget("record", "displayName")
    ).otherwise(vget("record", "display_name"))
    return records.withColumn("dialect", dialect_of()).select(
        "app",
        "pos",
        "dialect",
        named.alias("display_name"),
        vget("record", "description").alias("description"),
        "record",
    )


def build_apps(records: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """One row per application, the first record winning, with its products."""
    fields = F.struct("dialect", "display_name", "description", "record")
    first = normalise(records).groupBy("app").agg(F.min_by(fields, "pos").alias("r")).select("app", "r.*")
    if products is None:
        return first.withColumn("products", F.lit(None).cast("array<string>"))
    # Names that differ by case are one application: its product lists are joined, each product once.
    lists = F.array_distinct(F.flatten(F.array_sort(F.collect_list("products"))))
    by_key = products.groupBy(F.lower("app").alias("__key")).agg(lists.alias("products"))
    return first.join(by_key, F.lower("app") == F.col("__key"), "left").drop("__key")


def build_objects(summaries: DataFrame, schemas: DataFrame, apps: DataFrame, patch: bool = True) -> tuple[DataFrame, DataFrame]:
    """Objects of known applications with their schema if there is one, and the rejected orphans."""
    unique = summaries.groupBy("app", "object").agg(F.max_by("summary", "pos").alias("summary"))
    known = unique.join(apps.select("app", "dialect"), "app", "inner")
    orphans = unique.join(apps.select("app"), "app", "left_anti")
    nested_name = vget("summary", "displayName")
    if patch:
        nested_name = F.coalesce(nested_name, vget("summary", "display.name"))
    display = F.when(F.col("dialect") == "nested", nested_name).otherwise(vget("summary", "display_name"))
    objects = known.join(schemas.select("app", "object", F.col("doc").alias("schema")), ["app", "object"], "left")
    return (
        objects.select(
            "app",
            "object",
            "dialect",
            display.alias("display_name"),
            vget("summary", "description").alias("description"),
            "summary",
            "schema",
        ),
        orphans,
    )


def interactions(objects: DataFrame) -> DataFrame:
    """``(app, object, dialect, op, data, summary, schema)``: interactions of the schema, else of the summary."""
    source = F.when(F.col("schema").isNotNull(), vget("schema", "interactions", "variant")).otherwise(
        vget("summary", "interactions", "variant")
    )
    rows = explode_variant(
        objects.select("app", "object", "dialect", "summary", "schema", source.alias("inter")), "inter"
    )
    return rows.select(
        "app", "object", "dialect", F.col("key").alias("op"), F.col("value").alias("data"), "summary", "schema"
    )


def interaction_names(objects: DataFrame, source: str) -> DataFrame:
    """``(app, object, op)`` named by the ``summary`` or the ``schema`` of the objects that have both."""
    both = objects.where(F.col("schema").isNotNull() & F.col("summary").isNotNull())
    rows = both.select("app", "object", vget(source, "interactions", "variant").alias("inter"))
    return explode_variant(rows, "inter").select("app", "object", F.col("key").alias("op"))


def known_pair(kind: Column, op: Column) -> Column:
    return ((kind == "actions") & op.isin(ACTIONS)) | ((kind == "triggers") & op.isin(TRIGGERS))


def patched_kind(kind: Column, patches=tuple(KIND_PATCHES)) -> Column:
    """Declared kind after the point corrections."""
    out = kind
    for app, obj, op, value in patches:
        hit = (F.col("app") == app) & (F.col("object") == obj) & (F.col("op") == op)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def build_operations(objects: DataFrame) -> DataFrame:
    """Operations with a known (kind, name) pair, normalised over both dialects."""

    def member(doc: str) -> Column:
        inter = vget(doc, "interactions", "variant").try_cast("map<string,variant>")
        return F.try_element_at(inter, F.col("op"))

    rows = interactions(objects).withColumn("declared", patched_kind(vget("data", "type")))
    rows = rows.where(known_pair(F.col("declared"), F.col("op")))
    rows = rows.withColumn("op_summary", member("summary")).withColumn("op_details", member("schema"))
    nested = F.col("dialect") == "nested"
    own = F.when(nested, vget("op_summary", "type")).otherwise(vget("op_details", "type"))
    kind = F.coalesce(patched_kind(own), operation_kind(F.col("op")))
    return rows.select(
        "app",
        "object",
        "op",
        kind.alias("kind"),
        F.when(nested, vget("op_summary", "display.name")).otherwise(vget("op_summary", "display_name")).alias("display_name"),
        F.when(nested, vget("op_summary", "display.description"))
        .otherwise(vget("op_summary", "description"))
        .alias("description"),
        "data",
        vget("schema", "properties", "variant").alias("properties"),
        "dialect",
        "op_summary",
        "op_details",
    )


def build_properties(operations: DataFrame) -> DataFrame:
    """Properties of requests and responses: the ``included`` ones, or all that are not ``excluded``."""
    directions = F.array(
        F.struct(F.lit("request").alias("direction"), vget("data", "requestProperties", "variant").alias("spec")),
        F.struct(F.lit("response").alias("direction"), vget("data", "responseProperties", "variant").alias("spec")),
    )
    specs = operations.select("app", "object", "op", "properties", F.explode(directions).alias("d"))
    specs = specs.select(
        "app",
        "object",
        "op",
        "properties",
        F.col("d.direction").alias("direction"),
        vget("d.spec", "included", "array<string>").alias("included"),
        vget("d.spec", "excluded", "array<string>").alias("excluded"),
    )
    keys = ["app", "object", "op", "direction"]
    included = specs.select(*keys, "properties", F.explode("included").alias("prop_path"))
    included = included.withColumn("spec", resolve_path(F.col("properties"), F.col("prop_path")))
    included = included.where(F.col("spec").isNotNull()).drop("properties")
    by_exclusion = specs.where(F.col("included").isNull() & F.col("excluded").isNotNull())
    exploded = explode_variant(by_exclusion, "properties").where(~F.array_contains("excluded", F.col("key")))
    excluded = exploded.select(*keys, F.col("key").alias("prop_path"), F.col("value").alias("spec"))
    return included.unionByName(excluded)


def object_properties(objects: DataFrame) -> DataFrame:
    """``(app, object, prop, spec)`` of every schema."""
    rows = objects.select("app", "object", vget("schema", "properties", "variant").alias("properties"))
    exploded = explode_variant(rows, "properties")
    return exploded.select("app", "object", F.col("key").alias("prop"), F.col("value").alias("spec"))


# --- Accounts -------------------------------------------------------------------------------------


def first_account(accounts: DataFrame, order: str) -> DataFrame:
    """First account of each application and how many there are."""
    return accounts.groupBy("app").agg(F.min_by("account", order).alias("account"), F.count(F.lit(1)).alias("n_accounts"))


def accounts_of(accounts: DataFrame, apps: DataFrame | None = None) -> DataFrame:
    """All accounts with the application that they connect, of the given applications only if there are any given."""
    return accounts if apps is None else accounts.join(apps.select("app").distinct(), "app", "left_semi")


def account_gaps(apps: DataFrame, accounts: DataFrame) -> DataFrame:
    """``(app, gap)``: applications without an account and accounts without an application."""
    missing = apps.select("app").distinct().join(accounts.select("app").distinct(), "app", "left_anti")
    extra = accounts.select("app").distinct().join(apps.select("app").distinct(), "app", "left_anti")
    return missing.withColumn("gap", F.lit("no account")).unionByName(extra.withColumn("gap", F.lit("no application")))


# --- Views ------------------------------------------------------------------------------------------


def rollup_kinds(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """Kinds of each object's operations, both when it has none."""
    kinds = operations.groupBy("app", "object").agg(F.sort_array(F.collect_set("kind")).alias("op_types"))
    both = F.array(*[F.lit(k) for k in KINDS])
    joined = objects.join(kinds, ["app", "object"], "left")
    empty = F.col("op_types").isNull() | (F.size("op_types") == 0)
    return joined.withColumn("op_types", F.when(empty, both).otherwise(F.col("op_types")))


def commands(apps: DataFrame, objects: DataFrame, operations: DataFrame) -> DataFrame:
    """One row per operation with its path, description and the three display names."""
    o = objects.select("app", "object", F.col("display_name").alias("object_display_name"))
    a = apps.select("app", F.col("display_name").alias("app_display_name"))
    rows = operations.join(o, ["app", "object"], "inner").join(a, "app", "inner")
    return rows.select(
        F.concat_ws(".", "app", "object", "op").alias("command"),
        "app",
        "object",
        "op",
        "kind",
        "description",
        "app_display_name",
        "object_display_name",
        F.col("display_name").alias("operation_display_name"),
    )


def elements(apps: DataFrame, objects: DataFrame, operations: DataFrame) -> DataFrame:
    """All elements with dense ids (by digest of the full name) and the ids of their parents."""
    none = F.lit(None)
    a = apps.select(
        F.lit(TAG_APP).alias("typename"),
        F.col("app").alias("full_name"),
        none.cast("string").alias("parent_name"),
        none.cast("array<string>").alias("op_types"),
        "products",
    )
    products = apps.select("app", "products")
    o = objects.join(products, "app", "left").select(
        F.lit(TAG_OBJECT).alias("typename"),
        F.concat_ws("/", "app", "object").alias("full_name"),
        F.col("app").alias("parent_name"),
        "op_types",
        "products",
    )
    p = operations.join(products, "app", "left").select(
        F.lit(TAG_OPERATION).alias("typename"),
        F.concat_ws("/", "app", "object", "op").alias("full_name"),
        F.concat_ws("/", "app", "object").alias("parent_name"),
        F.array("kind").alias("op_types"),
        "products",
    )
    rows = a.unionByName(o).unionByName(p)
    numbered = cut_lineage(number_rows(rows, [], F.md5("full_name"), ties=["full_name"], out="element_id"))
    parents = numbered.where(F.col("typename") != TAG_OPERATION).select(
        F.col("full_name").alias("parent_name"), F.col("element_id").alias("parent_id")
    )
    return numbered.join(parents, "parent_name", "left")


def by_name(all_elements: DataFrame, names: DataFrame) -> DataFrame:
    """Elements with the given ``full_name`` values; unknown names keep a row of nulls."""
    return names.join(all_elements, "full_name", "left")


def vertices(apps: DataFrame, objects: DataFrame, operations: DataFrame) -> DataFrame:
    """``(label, full_name, name, display_name, description)``, empty text for missing values."""

    def part(df: DataFrame, label: str, name: str, full: Column) -> DataFrame:
        texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("display_name", "description")]
        return df.select(F.lit(label).alias("label"), full.alias("full_name"), F.col(name).alias("name"), *texts)

    return (
        part(apps, TAG_APP, "app", F.col("app"))
        .unionByName(part(objects, TAG_OBJECT, "object", F.concat_ws("/", "app", "object")))
        .unionByName(part(operations, TAG_OPERATION, "op", F.concat_ws("/", "app", "object", "op")))
    )


def edges(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """``(edge, src, dst)`` over full names."""
    full = F.concat_ws("/", "app", "object")
    o = objects.select(F.lit("business_object").alias("edge"), F.col("app").alias("src"), full.alias("dst"))
    p = operations.select(
        F.lit("operation").alias("edge"), full.alias("src"), F.concat_ws("/", "app", "object", "op").alias("dst")
    )
    return o.unionByName(p)


def graph_counts(vertex_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    v = vertex_rows.groupBy(F.concat(F.lit("vertex:"), "label").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    e = edge_rows.groupBy(F.concat(F.lit("edge:"), "edge").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return v.unionByName(e)


def apps_by_product(apps: DataFrame) -> DataFrame:
    """``(product, app)`` in product and name order, one row each (a range-partitioned sort)."""
    rows = apps.select(F.explode("products").alias("product"), "app").distinct()
    return rows.orderBy("product", "app")


def missing_apps(products: DataFrame, apps: DataFrame) -> DataFrame:
    """Applications of the product table that the catalog lacks."""
    return products.select("app").distinct().join(apps.select("app"), "app", "left_anti")


def type_counts(all_elements: DataFrame) -> DataFrame:
    """Number of elements of each type, zeros included, from one pass."""
    tags = (TAG_APP, TAG_OBJECT, TAG_OPERATION)
    one_row = all_elements.agg(*[F.count_if(F.col("typename") == t).alias(t) for t in tags])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("typename"), F.col(t).alias("n")) for t in tags]))
    return one_row.select(pairs.alias("p")).select("p.*")


def audit(apps: DataFrame, operations: DataFrame) -> DataFrame:
    """Applications without products and operations without a kind."""
    a = apps.where(F.col("products").isNull()).select(F.lit("no product").alias("problem"), F.col("app").alias("name"))
    o = operations.where(F.col("kind").isNull()).select(
        F.lit("no kind").alias("problem"), F.concat_ws("/", "app", "object", "op").alias("name")
    )
    return a.distinct().unionByName(o.distinct())
