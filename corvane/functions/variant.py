"""Access to schema-less JSON held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vget(doc: Column | str, path: str, as_type: str = "string") -> Column:
    """Value at a path, null when it is absent or of another type."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, f"$.{path}", as_type)


def has_key(doc: Column | str, path: str) -> Column:
    """True when the key is present, even with a JSON null."""
    return vget(doc, path, "variant").isNotNull()


def has_value(doc: Column | str, path: str) -> Column:
    """True when the key is present with a value other than JSON null."""
    value = vget(doc, path, "variant")
    return F.coalesce(value.isNotNull() & ~F.is_variant_null(value), F.lit(False))


def is_array(doc: Column | str) -> Column:
    return F.schema_of_variant(F.col(doc) if isinstance(doc, str) else doc).startswith("ARRAY")


def explode_variant(df: DataFrame, doc: str, pos: str = "pos", key: str = "key", value: str = "value") -> DataFrame:
    """One row per member of a VARIANT object or array; rows with neither vanish."""
    exploded = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(doc).outer()))
    return exploded.withColumnsRenamed({"pos": pos, "key": key, "value": value})


def resolve_path(properties: Column, path: Column) -> Column:
    """Property at a dotted path. Each step goes through ``type``, or through its first element when it is a list.

    The steps of a path are folded, so paths of any depth are followed.
    """
    parts = F.split(path, r"\.")

    def member(node: Column, name: Column) -> Column:
        return F.try_element_at(node.try_cast("map<string,variant>"), name)

    def step(node: Column, name: Column) -> Column:
        nested = F.coalesce(
            F.try_variant_get(node, "$.type[0]", "variant"), F.try_variant_get(node, "$.type", "variant")
        )
        return member(nested, name)

    root = member(properties, F.get(parts, F.lit(0)))
    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), root, step)
