"""Files of both dialects, with every irregularity the readers know about."""

import json

import pytest

from corvane.operators import catalog as c
from corvane.operators import quality
from corvane.plans.catalog import Catalog
from corvane.sources import catalog_files as files
from corvane.sources import tables, text_records


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def catalog_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    apps = {
        "gmail": {"name": "gmail", "display_name": "Gmail", "description": "Mail", "version": "1"},
        "box": {"name": "box", "displayName": "Box"},
        "legacy": {"name": "legacy", "display_name": "Legacy", "version": "cp4i"},
        "nolisting": {"name": "nolisting", "display_name": "None"},
        "broken": {"name": "broken", "display_name": "Broken"},
        "streaming-connector-scheduler": {"name": "streaming-connector-scheduler"},
    }
    (root / "applications.json").write_text(json.dumps(apps))
    listing = root / "application_objects"
    schema = root / "object_schemas"
    for d in (listing, schema, schema / "gmail", schema / "box"):
        d.mkdir()
    mail = {
        "name": "mail",
        "display_name": "Mail",
        "description": "A mail",
        "interactions": {
            "CREATED": {"type": "actions", "display_name": "New mail", "description": "When a mail arrives"},
            "CREATE": {"type": "actions", "display_name": "Send mail", "description": "Sends a mail"},
            "OLDOP": {"type": "actions", "display_name": "x", "description": "y"},
        },
    }
    label = {"name": "label", "display_name": "Label", "interactions": {"CREATE": {"type": "nonsense"}, "UPDATE": {"type": "actions"}}}
    (listing / "gmail.json").write_text(json.dumps({"objects": [mail, label]}))
    file_obj = {
        "name": "file",
        "description": "A file",
        "display": {"name": "File", "description": "Some file"},
        "interactions": {"UPDATED": {"type": "triggers", "display": {"name": "Changed file", "description": "On change"}}},
    }
    (listing / "box.json").write_text(json.dumps([file_obj]))
    (listing / "legacy.json").write_text(json.dumps([{"name": "row", "displayName": "Row", "interactions": {}}]))
    (listing / "broken.json").write_text(json.dumps({"errors": [{"message": "no"}]}))
    mail_schema = {
        "properties": {
            "id": {"type": "string"},
            "to": {"type": {"name": {"type": "string"}, "address": {"type": {"zip": {"type": "int"}}}}},
            "parts": {"type": [{"size": {"type": "int"}}]},
        },
        "interactions": {
            "CREATED": {"type": "actions", "responseProperties": {"excluded": ["id", "ghost"]}},
            "CREATE": {
                "type": "actions",
                "requestProperties": {"included": ["to.address.zip", "parts.size", "id.none", "gone"], "excluded": ["id"], "mandatory": ["id"]},
            },
            "DELETEALL": {"type": "actions"},
        },
    }
    (schema / "gmail" / "mail.json").write_text(json.dumps(mail_schema))
    (schema / "box" / "file.json").write_text(json.dumps({"errors": [{"message": "gone"}]}))
    products = root / "products.csv"
    products.write_text("GMail,Google Mail,alpha;beta\n?,skip,alpha\nbox,Box,beta\nabsent,Absent,alpha\n")
    return root


@pytest.fixture(scope="module")
def catalog(spark, catalog_dir):
    return Catalog.read(spark, str(catalog_dir), str(catalog_dir / "products.csv"))


def test_apps(catalog):
    got = rows(catalog.apps.select("app", "dialect", "display_name"))
    assert got == {("gmail", "flat", "Gmail"), ("box", "nested", "Box"), ("legacy", "nested", "Legacy")}
    products = {r.app: r.products for r in catalog.apps.collect()}
    assert products == {"gmail": ["alpha", "beta"], "box": ["beta"], "legacy": None}


def test_filter_reaches_the_files(spark, catalog_dir):
    only = Catalog.read(spark, str(catalog_dir), apps=["box"])
    assert rows(only.operations.select("app", "object", "op")) == {("box", "file", "UPDATED")}


def test_operations(catalog):
    got = rows(catalog.operations.select("app", "object", "op", "kind", "display_name", "description"))
    assert got == {
        ("gmail", "mail", "CREATED", "triggers", "New mail", "When a mail arrives"),
        ("gmail", "mail", "CREATE", "actions", "Send mail", "Sends a mail"),
        ("gmail", "mail", "DELETEALL", "actions", None, None),
        ("gmail", "label", "UPDATE", "actions", None, None),
        ("box", "file", "UPDATED", "triggers", "Changed file", "On change"),
    }


def test_objects(catalog):
    got = {(r.app, r.object): (r.display_name, sorted(r.op_types)) for r in catalog.objects.collect()}
    assert got[("gmail", "mail")] == ("Mail", ["actions", "triggers"])
    assert got[("box", "file")] == ("File", ["triggers"])
    assert got[("legacy", "row")] == ("Row", ["actions", "triggers"])


def test_properties(catalog):
    got = rows(catalog.properties.select("op", "direction", "prop_path"))
    assert got == {
        ("CREATE", "request", "to.address.zip"),
        ("CREATE", "request", "parts.size"),
        ("CREATED", "response", "to"),
        ("CREATED", "response", "parts"),
    }


def test_elements_graph_and_lookup(spark, catalog):
    elements = catalog.elements
    assert {r.typename: r.n for r in c.type_counts(elements).collect()} == {"app": 3, "bo": 4, "op": 5}
    ids = [r.element_id for r in elements.collect()]
    assert sorted(ids) == list(range(12))
    names = spark.createDataFrame([("gmail/mail/CREATE",), ("gmail/none",)], "full_name string")
    found = {r.full_name: r.typename for r in c.by_name(elements, names).collect()}
    assert found == {"gmail/mail/CREATE": "op", "gmail/none": None}
    assert {(r.part, r.n) for r in c.graph_counts(catalog.vertices, catalog.edges).collect()} == {
        ("vertex:app", 3), ("vertex:bo", 4), ("vertex:op", 5), ("edge:business_object", 4), ("edge:operation", 5),
    }
    assert all(r.description is not None for r in catalog.vertices.collect())


def test_skipped_and_orphans(spark, catalog_dir):
    records = files.read_apps(spark, f"{catalog_dir}/applications.json")
    listings = files.read_listings(spark, f"{catalog_dir}/application_objects")
    assert rows(files.skipped_apps(records, listings)) == {("nolisting",)}
    assert rows(files.list_available(spark, f"{catalog_dir}/application_objects/*.json")) == {("gmail",), ("box",), ("legacy",), ("broken",)}
    objects = files.read_objects(spark, f"{catalog_dir}/application_objects")
    schemas = files.read_schemas(spark, f"{catalog_dir}/object_schemas")
    _, orphans = c.build_objects(objects, schemas, c.build_apps(records.where("app = 'box'")))
    assert rows(orphans.select("app", "object")) == {("gmail", "mail"), ("gmail", "label"), ("legacy", "row")}


def test_warnings(catalog):
    apps = {r.app: r.warnings for r in quality.with_warnings(catalog.apps, quality.app_warnings()).collect()}
    assert apps == {"box": ["no description"], "legacy": ["no displayName", "no description"]}
    objects = {r.object: r.warnings for r in quality.with_warnings(catalog.objects, quality.object_warnings()).collect()}
    assert objects["file"] == ["label-conflict: - | File", "no displayName, display.name used"]
    assert objects["label"] == ["no description"]
    assert objects["row"] == [
        "label-conflict: Row | -", "no description", "no display.description", "no display.name",
    ]


def test_operation_warnings(catalog):
    rows_ = quality.with_warnings(catalog.operations, quality.operation_warnings()).collect()
    assert {(r.object, r.op): r.warnings for r in rows_} == {
        ("mail", "DELETEALL"): ["no description", "no display_name"],
        ("label", "UPDATE"): ["no description", "no display_name"],
    }


def test_interactions_of_summary_and_schema(catalog):
    names = [c.interaction_names(catalog.objects, source) for source in ("summary", "schema")]
    diff = quality.diff_interactions(*names, ["app", "object", "op"])
    assert rows(diff) == {("gmail", "mail", "OLDOP", "summary only"), ("gmail", "mail", "DELETEALL", "schema only")}


def test_utterances_of_files(catalog):
    texts = {(r.command, r.source): r.description for r in catalog.utterances(seed=None).collect()}
    assert texts[("gmail.mail.CREATE", 3)] == "Create a gmail mail."
    assert texts[("gmail.mail.CREATED", 4)] == "Triggers when a Gmail Mail is created."
    assert ("gmail.mail.DELETEALL", 3) not in texts  # incomplete rows are dropped


def test_products(spark, catalog_dir):
    products = tables.read_products(spark, str(catalog_dir / "products.csv"))
    assert rows(tables.apps_for_target(products, "ALPHA")) == {("GMail",), ("absent",)}
    assert rows(tables.read_products(spark, str(catalog_dir / "products.csv"), ["box"]).select("app")) == {("box",)}


TEXT = """# comment
Send a mail
  gmail.mail.CREATE()
    deeper
@Mail something
@Mail something

 for x in y:
   gmail.mail.UPDATE
Second one
#skip
 box.file.CREATE
"""


def reference_records(text, variations):
    """Brute force over the lines."""
    out, current = [], None
    for line in text.split("\n"):
        if line == "" or line[0] == "#":
            continue
        if line[0] == " " or (variations and line[0] == "@"):
            current.append(line)
        else:
            current = [line]
            out.append(current)
    samples = set()
    for record in out:
        at = next((i for i, x in enumerate(record) if variations and x[0] == "@"), len(record))
        strip = lambda x: x[1:] if x[0] in (" ", "@") else x
        heads = ["".join(strip(x) + "\n" for x in record[:at])] + [x[1:] + "\n" for x in record[at:] if x[0] == "@"]
        tail = "".join(strip(x) + "\n" for x in record[at:] if x[0] != "@")
        samples |= {(h + tail).strip() for h in heads}
    return samples


@pytest.mark.parametrize("variations", [False, True])
def test_text_records(spark, tmp_path, variations):
    text = TEXT if variations else "".join(x for x in TEXT.splitlines(True) if x[0] != "@")
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("Other text\n a.b.CREATE\n")
    got = text_records.read_text_records(spark, str(tmp_path / "*.txt"), variations).collect()
    expected = reference_records(text, variations) | {"Other text\na.b.CREATE"}
    assert {r["sample"] for r in got} == expected and len(got) == len(expected)


def test_text_records_in_small_splits(spark, tmp_path):
    lines = []
    for i in range(400):
        lines += [f"utterance {i}", f" app.object{i}.CREATE", "# note"]
    (tmp_path / "large.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        pairs = text_records.eval_text(spark, str(tmp_path / "large.txt"))
        assert rows(pairs) == {(f"utterance {i}", f"app.object{i}.CREATE") for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_split_and_end_token(spark):
    df = spark.createDataFrame([("Do it\nfor x in a.b.RETRIEVEALL():\n  c.d.CREATE()",), ("alone",)], "sample string")
    got = text_records.split_records(df)
    assert rows(got) == {("Do it", "for x in a.b.RETRIEVEALL:\n\tc.d.CREATE"), ("alone", "")}


def test_csv_and_templates(spark, tmp_path):
    (tmp_path / "aliases.csv").write_text(",app_display_name,aliases\n0,Box,\"['bx', \"\"the box\"\"]\"\n1,Mail,[]\n")
    got = {r.app_display_name: r.aliases for r in tables.read_aliases(spark, str(tmp_path / "aliases.csv")).collect()}
    assert got == {"Box": ["bx", "the box"], "Mail": []}
    (tmp_path / "few_shot_v2_7.txt").write_text("Examples\nof seven")
    template = tables.read_templates(spark, str(tmp_path / "few_shot*.txt")).collect()
    assert [(r.type, r.template) for r in template] == [(7, "Examples\nof seven")]
    pairs = spark.createDataFrame([('say "hi", now', "a.b.C\n\td.e.F")], "utterances string, commands string")
    tables.write_eval(pairs, str(tmp_path / "eval"))
    back = tables.read_eval(spark, str(tmp_path / "eval"), "utterances string, commands string")
    assert rows(back) == rows(pairs)


def test_load_or_build(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "vectors")
    assert tables.load_or_build(spark, path, build, "hash").count() == 3
    assert tables.load_or_build(spark, path, build, "HASH").count() == 3
    assert len(built) == 1
    with pytest.raises(ValueError):
        tables.load_or_build(spark, path, build, "other")
    tables.load_or_build(spark, path, build, "other", reload=True)
    assert len(built) == 2


def test_filter_keeps_objects_without_schema(spark, tmp_path):
    from corvane.sources.catalog_files import read_listings, read_schemas

    for folder in ("objects", "schemas/b"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "objects/a.json").write_text("[]")
    (tmp_path / "objects/b.json").write_text("[]")
    (tmp_path / "schemas/b/o.json").write_text("{}")
    many = ["a", *(f"x{i}" for i in range(300))]
    for apps in (["a"], many):
        assert [r.app for r in read_listings(spark, str(tmp_path / "objects"), apps).collect()] == ["a"]
        assert read_schemas(spark, str(tmp_path / "schemas"), apps).count() == 0


def test_product_names_that_differ_by_case_are_one_app(spark):
    from corvane.operators.catalog import build_apps

    records = spark.sql("SELECT 'gmail' app, 0L pos, parse_json('{\"name\":\"gmail\"}') record")
    products = spark.createDataFrame([("GMail", ["b", "a"]), ("gmail", ["a", "c"])], "app string, products array<string>")
    rows = build_apps(records, products).collect()
    assert len(rows) == 1 and sorted(rows[0].products) == ["a", "b", "c"]


def test_index_counts_elements_once_and_first_filled_value_wins(spark):
    from corvane.operators.evalsets import eval_single_object
    from corvane.operators.grouping import description_index

    texts = spark.createDataFrame([("Mail", 1), ("mail", 1), ("mail", 2)], "text string, element int")
    assert [r.n_elements for r in description_index(texts, "text", "element").collect()] == [2]
    rows = spark.createDataFrame([("c", 1, None), ("c", 2, "x"), ("d", 1, None)], "command string, source int, description_censored string")
    assert {r.commands: r.utterances for r in eval_single_object(rows).collect()} == {"c": "x", "d": None}


def test_rows_of_a_null_group_are_numbered(spark):
    from pyspark.sql import functions as F

    from corvane.operators.skew import number_rows

    rows = spark.createDataFrame([(None, 1), (None, 2), ("g", 3)], "k string, v int")
    got = number_rows(rows, ["k"], F.md5(F.col("v").cast("string")), ["v"]).collect()
    assert sorted((r.k or "", r.idx) for r in got) == [("", 0), ("", 1), ("g", 0)]
