"""Inputs of the registered queries, derived by Spark from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import operation_kind

OPS = [
    "CREATE", "RETRIEVEALL", "UPDATE", "UPDATEALL", "DELETEALL", "UPSERTWITHWHERE", "CREATED", "UPDATED", "DELETED",
    "CREATED_POLLER", "UPDATED_POLLER", "CREATEDORUPDATED_POLLER", "CREATEDORUPDATED",
]

# Texts of the operations; {o} is the object, {A} the display name of the application.
TEXTS = {
    "CREATE": ("Creates a {o} in {A}.", "Create {o}"),
    "RETRIEVEALL": ("Retrieves all {o}s from {A}.", "{o}s"),
    "UPDATE": ("Updates a {o} in {A}.", "Update {o}"),
    "UPDATEALL": ("Updates all {o}s in {A}.", "Update {o}s"),
    "DELETEALL": ("Deletes all {o}s from {A}.", "Delete {o}s"),
    "UPSERTWITHWHERE": ("Updates or creates a {o} in {A}.", "Update or create {o}"),
    "CREATED": ("", "New {o}"),
    "UPDATED": ("Triggers when a {o} is updated in {A}.", "Updated {o}"),
    "DELETED": ("Triggers when a {o} is deleted in {A}.", "Deleted {o}"),
    "CREATED_POLLER": ("Triggers when a new {o} is found in {A}.", "New {o} (polled)"),
    "UPDATED_POLLER": ("Triggers when a changed {o} is found in {A}.", "Updated {o} (polled)"),
    "CREATEDORUPDATED_POLLER": ("Triggers when a new or changed {o} is found in {A}.", "New or updated {o} (polled)"),
    "CREATEDORUPDATED": ("New or updated {o}s in {A}", "New or updated {o}"),
}


def text_sql(which: int, op: str = "op", obj: str = "object", app: str = "app_display_name") -> str:
    """SQL expression (Spark and ANSI) of the description (0) or display name (1) of an operation."""

    def value(template: str) -> str:
        out = "'" + template.replace("{o}", f"' || {obj} || '").replace("{A}", f"' || {app} || '") + "'"
        return out.removeprefix("'' || ").removesuffix(" || ''")

    cases = " ".join(f"WHEN '{name}' THEN {value(texts[which])}" for name, texts in TEXTS.items())
    return f"CASE {op} {cases} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str, wide: bool = False, many: bool = False) -> DataFrame:
    """Distinct ``(app, object, op, app_display_name)`` of the parts; with ``many`` a brand is an application per size."""
    ops = "array(" + ", ".join(f"'{o}'" for o in OPS) + ")"
    obj = "replace(p_name, ' ', '') || p_size" if wide else "split(p_name, ' ')[1]"
    return (
        table(spark, sf_dir, "part")
        .select(
            F.expr("replace(lower(p_brand), '#', '')" + " || 'x' || p_size" * many).alias("app"),
            F.expr(obj).alias("object"),
            F.expr(f"{ops}[cast(p_partkey % 13 as int)]").alias("op"),
            F.expr("replace(p_brand, '#', ' ')" + " || ' ' || p_size" * many).alias("app_display_name"),
        )
        .distinct()
    )


def commands(spark: SparkSession, sf_dir: str, wide: bool = False, many: bool = False) -> DataFrame:
    """Catalog view of the parts: one row per operation with its texts."""
    return triplets(spark, sf_dir, wide, many).select(
        F.concat_ws(".", "app", "object", "op").alias("command"),
        "app",
        "object",
        "op",
        operation_kind(F.col("op")).alias("kind"),
        F.expr(text_sql(0)).alias("description"),
        "app_display_name",
        F.expr("upper(substring(object, 1, 1)) || substring(object, 2) || 's'").alias("object_display_name"),
        F.expr(text_sql(1)).alias("operation_display_name"),
    )


def nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary of the nouns that name the parts."""
    return table(spark, sf_dir, "part").select(F.expr("split(p_name, ' ')[1]").alias("lemma")).distinct()


def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(app, label, targets, pos)`` of all brands and of the suppliers, which the catalog does not have."""
    number = "cast(substring(p_brand, 7) as int)"
    targets = (
        f"concat_ws(';', case when {number} % 2 = 0 then 'server' end, case when {number} % 3 = 0 then 'cloud' end, "
        f"case when {number} % 2 <> 0 and {number} % 3 <> 0 then 'demo' end)"
    )
    brands = (
        table(spark, sf_dir, "part")
        .select(F.expr("replace(lower(p_brand), '#', '')").alias("app"), F.col("p_brand").alias("label"), F.expr(targets).alias("targets"))
        .distinct()
    )
    others = table(spark, sf_dir, "supplier").select(
        F.expr("case when s_suppkey = 0 then '?' else lower(s_name) end").alias("app"),
        F.col("s_name").alias("label"),
        F.lit("server;demo").alias("targets"),
    )
    return brands.unionByName(others).withColumn("pos", F.lit(0))


def silver(spark: SparkSession, sf_dir: str, wide: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``apps``, ``objects`` and ``operations`` of the catalog view, without products."""
    rows = commands(spark, sf_dir, wide)
    apps = rows.select("app", F.col("app_display_name").alias("display_name")).distinct()
    apps = apps.select("app", "display_name", F.lit(None).cast("string").alias("description"))
    objects = rows.select("app", "object", F.col("object_display_name").alias("display_name")).distinct()
    objects = objects.withColumn("description", F.concat(F.lit("All about "), F.col("display_name")))
    operations = rows.select(
        "app", "object", "op", "kind", F.col("operation_display_name").alias("display_name"), "description"
    )
    return apps, objects, operations


# --- The catalog view as JSON documents. Applications with an even number use the nested dialect. -------


def _nested() -> Column:
    return F.expr("cast(substring(app, 6) as int) % 2 = 0")


def app_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per application: maps for some, one-element lists for the others."""
    apps, _, _ = silver(spark, sf_dir)
    shown = F.col("display_name")
    record = F.to_json(
        F.struct(
            F.col("app").alias("name"),
            F.when(~_nested(), shown).alias("display_name"),
            F.when(_nested(), shown).alias("displayName"),
            F.when(F.length("app") == 7, F.concat(F.lit("About "), shown)).alias("description"),
        )
    )
    as_map = F.concat(F.lit('{"'), F.col("app"), F.lit('":'), record, F.lit("}"))
    as_list = F.concat(F.lit("["), record, F.lit(',{"name":"streaming-connector-scheduler"}]'))
    return apps.select(F.parse_json(F.when(F.length("app") == 6, as_list).otherwise(as_map)).alias("doc"))


def _operations_json(nested: bool) -> Column:
    """Map of the operations of one object; an object has at most the thirteen known ones."""
    display, text = F.col("display_name"), F.col("description")
    if nested:
        value = F.struct(
            F.col("kind").alias("type"), F.struct(display.alias("name"), text.alias("description")).alias("display")
        )
    else:
        value = F.struct(F.col("kind").alias("type"), display.alias("display_name"), text.alias("description"))
    return F.map_from_entries(F.collect_list(F.struct(F.col("op"), F.to_json(value))))


def _raw_map(entries: Column) -> Column:
    """JSON object of a map of JSON texts."""
    pairs = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def listing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(app, doc)``: one listing document per object, an error document for the objects called gizmo of brand2x."""
    _, objects, operations = silver(spark, sf_dir)
    grouped = operations.groupBy("app", "object").agg(
        _operations_json(False).alias("flat_ops"), _operations_json(True).alias("nested_ops")
    )
    rows = grouped.join(objects, ["app", "object"], "inner")
    shown, text = F.col("display_name"), F.col("description")
    flat_head = F.to_json(F.struct(F.col("object").alias("name"), shown.alias("display_name"), text.alias("description")))
    mark = F.when(F.col("object") == "gear", F.lit("!")).otherwise(F.lit(""))
    nested_head = F.to_json(
        F.struct(
            F.col("object").alias("name"),
            F.when(F.col("object") != "rod", shown).alias("displayName"),
            F.when(F.col("object") != "bolt", text).alias("description"),
            F.struct(F.concat(shown, mark).alias("name"), text.alias("description")).alias("display"),
        )
    )

    def with_ops(head: Column, ops: str) -> Column:
        opened = F.substring(head, F.lit(1), F.length(head) - 1)
        return F.concat(opened, F.lit(',"interactions":'), _raw_map(F.col(ops)), F.lit("}"))

    flat, nested = with_ops(flat_head, "flat_ops"), with_ops(nested_head, "nested_ops")
    broken = (F.col("object") == "gizmo") & F.col("app").startswith("brand2")
    doc = (
        F.when(broken, F.lit('{"errors":[{"message":"not available"}]}'))
        .when(_nested(), F.concat(F.lit("["), nested, F.lit("]")))
        .otherwise(F.concat(F.lit('{"objects":['), flat, F.lit("]}")))
    )
    return rows.select("app", F.parse_json(doc).alias("doc"))


def schema_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(app, object, doc)`` for flat objects but rods: properties, and operations without the DELETED one."""
    _, _, operations = silver(spark, sf_dir)
    include = F.lit('{"included":["id","owner.name","tags.label","missing.path"],"excluded":["id"]}')
    exclude = F.lit('{"excluded":["id","unknown"]}')
    spec = F.when(F.col("kind") == "actions", include).otherwise(exclude)
    value = F.concat(
        F.lit('{"type":"'), F.col("kind"), F.lit('","requestProperties":'), spec, F.lit(',"responseProperties":'), exclude, F.lit("}")
    )
    rows = operations.where(~_nested() & (F.col("object") != "rod") & (F.col("op") != "DELETED"))
    grouped = rows.groupBy("app", "object").agg(F.map_from_entries(F.collect_list(F.struct("op", value))).alias("ops"))
    properties = (
        '{"id":{"type":"string"},"owner":{"type":{"name":{"type":"string"},"age":{"type":"int"}}},'
        '"tags":{"type":[{"label":{"type":"string"}}]}}'
    )
    doc = F.concat(F.lit('{"properties":' + properties + ',"interactions":'), _raw_map(F.col("ops")), F.lit("}"))
    broken = F.col("object") == "plate"
    return grouped.select(
        "app", "object", F.parse_json(F.when(broken, F.lit('{"errors":[]}')).otherwise(doc)).alias("doc")
    )


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app > object > operation`` documents, one per object."""
    rows = commands(spark, sf_dir)
    value = F.to_json(F.struct(F.col("description").alias("command_description"), "app_display_name"))
    grouped = rows.groupBy("app", "object").agg(F.map_from_entries(F.collect_list(F.struct("op", value))).alias("ops"))
    inner = F.concat(F.lit('{"'), F.col("object"), F.lit('":'), _raw_map(F.col("ops")), F.lit("}"))
    return grouped.select(F.parse_json(F.concat(F.lit('{"'), F.col("app"), F.lit('":'), inner, F.lit("}"))).alias("doc"))


# --- Vectors ------------------------------------------------------------------------------------------


def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the vectors of 25 applications, 200 objects and the rest operations."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("vec_id").alias("element_id"),
        F.expr("case when vec_id < 25 then 'app' when vec_id < 225 then 'bo' else 'op' end").alias("typename"),
        F.expr("case when vec_id < 25 then null when vec_id < 225 then vec_id % 25 else 25 + vec_id % 200 end").alias("parent_id"),
        F.expr(
            "case when vec_id < 25 then null when vec_id < 225 then array('actions', 'triggers') "
            "when label < 6 then array('actions') else array('triggers') end"
        ).alias("op_types"),
        F.expr("case when label = 0 then array('server') else array('server', 'cloud') end").alias("products"),
        "embedding",
        "label",
    )


def element_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(element_id, full_name, op_types)`` of the tree: the names of the elements above, then the own one."""
    name = (
        "case when vec_id < 25 then 'app' || vec_id when vec_id < 225 then 'app' || vec_id % 25 || '/bo' || vec_id "
        "else 'app' || (25 + vec_id % 200) % 25 || '/bo' || (25 + vec_id % 200) || '/op' || vec_id end"
    )
    return element_tree(spark, sf_dir).select("element_id", F.expr(name).alias("full_name"), "op_types")


def match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a request; every third label asks for a kind."""
    kind = "case label when 1 then 'actions' when 4 then 'triggers' when 7 then 'actions' end"
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("request_id"),
        F.col("embedding").alias("app_vec"),
        F.col("embedding").alias("object_vec"),
        F.col("embedding").alias("op_vec"),
        F.expr(kind).alias("kind"),
    )


# --- Conversations ----------------------------------------------------------------------------------


def test_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows as label and, partly changed, as generation."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("utterances"))
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("commands")
    )
    generation = F.expr(
        "case conv_id % 3 when 0 then commands || ' x' when 1 then '[' || commands || ']' else 'Answer: ' || commands end"
    )
    rows = user.join(reply, ["conv_id", "turn"], "inner").withColumn("generations", generation)
    return rows.withColumn("type", F.expr("conv_id % 8 + 1")).withColumn("subtype", F.expr("case when turn = 0 then 'first' else 'later' end"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the lines of one text file per conversation."""
    turns = table(spark, sf_dir, "conversations")
    opening = turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.min("turn").alias("opening"))
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    line = (
        F.when(F.col("role") == "system", F.concat(F.lit("#"), flat))
        .when(F.col("role") == "assistant", F.concat(F.lit(" "), flat))
        .when(F.col("turn") == F.col("opening"), flat)
        .otherwise(F.concat(F.lit("@"), flat))
    )
    return turns.join(opening, "conv_id", "left").select("conv_id", "turn", line.alias("line"))
