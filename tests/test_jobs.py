"""Refresh, paraphrases, evaluation and scores on rows that can be checked by eye."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import canonical_vars, clean_generation
from corvane.operators import evalsets, grouping, paraphrase, scoring
from corvane.operators.lemma import verb_lemmatiser
from corvane.plans import queries
from corvane.plans.catalog import Catalog
from corvane.streaming.refresh import clamp_timeouts, refresh

NOW = dt.datetime(2024, 1, 10)


def day(n):
    return dt.datetime(2024, 1, n)


@pytest.mark.parametrize(
    "app_timeout,obj_timeout,taken",
    [
        (None, None, {("new", "o")}),  # whatever exists is fresh, and a fresh application shields its objects
        (86400 * 3, None, {("old", "missing"), ("new", "o")}),
        (86400 * 3, 86400 * 4, {("old", "missing"), ("old", "o1"), ("new", "o")}),
        (86400 * 9, 86400 * 4, {("old", "missing"), ("old", "o1"), ("new", "o")}),  # clamped to the object timeout
    ],
)
def test_refresh(spark, app_timeout, obj_timeout, taken):
    schema = "app string, object string, modified timestamp, payload string"
    incoming = [("old", "o1", NOW, "in"), ("old", "o2", NOW, "in"), ("old", "missing", NOW, "in"), ("fresh", "o", NOW, "in"), ("new", "o", NOW, "in")]
    current = [("old", "o1", day(3), "st"), ("old", "o2", day(9), "st"), ("fresh", "o", day(1), "st"), ("gone", "o", day(1), "st")]
    apps = [("old", day(5)), ("fresh", day(9)), ("gone", day(1))]
    rows = refresh(
        spark.createDataFrame(incoming, schema),
        spark.createDataFrame(current, schema),
        spark.createDataFrame(apps, "app string, modified timestamp"),
        F.lit(NOW),
        app_timeout,
        obj_timeout,
    ).collect()
    assert {(r.app, r.object) for r in rows if r.refreshed} == taken
    assert {(r.app, r.object) for r in rows if not r.refreshed} == {x[:2] for x in current} - taken
    assert all(r.payload == ("in" if r.refreshed else "st") for r in rows)


def test_clamp():
    assert clamp_timeouts(None, 5) == (5, 5) and clamp_timeouts(9, 5) == (5, 5)
    assert clamp_timeouts(3, 5) == (3, 5) and clamp_timeouts(7, None) == (7, None)


def test_paraphrases(spark):
    samples = spark.createDataFrame(
        [(1, 2, "Do this..", ["slack"]), (2, 1, "Keep", ["box"]), (3, 3, "Other.", ["box", "jira"])],
        "id int, type int, utterances string, app_list array<string>",
    )
    templates = spark.createDataFrame([(2, "a_2.txt", "old"), (2, "b_2.txt", "new"), (3, "c_3.txt", "T")], "type int, file string, template string")
    requests = {r.id: r.request for r in paraphrase.paraphrase_requests(samples, templates).collect()}
    assert requests == {1: "new\n\nPhrase:\nDo this.\nParaphrase:\n", 3: "T\n\nPhrase:\nOther.\nParaphrase:\n"}
    generations = spark.createDataFrame([(1, "Tell slack. And more."), (3, None)], "id int, generation string")
    got = {r.id: (r.paraphrased_utterances, r.partial_ratios) for r in paraphrase.score_paraphrases(samples, generations, templates, "id").collect()}
    assert got[1] == ("Tell slack.", [100]) and got[2] == (None, None)
    assert got[3][0] == "Other." and len(got[3][1]) == 2


def test_cleaning(spark):
    texts = [
        ("Sure: a.b.C", "a.b.C"),
        ("[a.b.C\\n]", "a.b.Cn"),
        ("for item in a.b.C:\n\tc.d.E", "for x in a.b.C:\n c.d.E"),
        ("x: y: z", "y: z"),
        ("If this: y", "If this: y"),
        ("plain", "plain"),
    ]
    df = spark.createDataFrame(texts, "t string, e string")
    rows = df.select("e", clean_generation(F.col("t")).alias("g"), clean_generation(F.col("t"), compat=True).alias("c")).collect()
    assert [r.g for r in rows] == [r.e for r in rows]
    assert rows[3].c == "y"
    assert spark.range(1).select(canonical_vars(F.lit("for a in b\nfor c in d")).alias("v")).first().v == "for x in b\nfor x in d"


def test_scores(spark):
    test = spark.createDataFrame(
        [
            (1, "use slack", "slack.msg.CREATE", "[slack.msg.CREATE]", 1, "s"),
            (2, "use it", "box.f.CREATED", "box.f.CREATE", 1, "s"),
            (3, "loop", "for item in a.b.C:\n\td.e.F", "for z in a.b.C:\n d.e.F", 2, "t"),
        ],
        "id int, utterances string, commands string, generations string, type int, subtype string",
    )
    hits = spark.createDataFrame([(1, 1, "slack.msg.CREATE", "d1"), (2, 1, "box.f.CREATE", "d2"), (2, 6, "far", "d3")], "id int, rank int, path string, description string")
    exact = scoring.exact_match(test)
    assert {r.id: r.exact for r in exact.collect()} == {1: True, 2: False, 3: True}
    assert {r.id: r.hit for r in scoring.hit_at_k(test, hits, "id").collect()} == {1: True, 2: False, 3: False}
    assert {r.id: r.hit for r in scoring.hit_at_k(test, hits, "id", compat=True).collect()} == {1: True, 2: True, 3: False}
    report = scoring.report(scoring.hit_at_k(exact, hits, "id"), ["type"]).collect()
    assert {(r.type, r.n, r.n_exact, r.n_hit) for r in report} == {(1, 2, 1, 1), (2, 1, 1, 0)}
    assert {(r.id, r.app) for r in scoring.needs_app(test).collect()} == {(2, "box"), (3, "a")}
    prompt = {r.id: r.prompt for r in scoring.prompts(test, hits, "id", "options").collect()}
    assert prompt[2] == " utterance: <use it </s>>\n    Output can be one of those:\n    box.f.CREATE\n    "
    pairs = {r.id: r.prompt for r in scoring.prompts(test, hits, "id", "pairs_and_apps", apps="slack, box").collect()}
    assert "    d1: slack.msg.CREATE\n" in pairs[1] and "applications = {slack, box}" in pairs[1]
    rounds = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "d", False), (2, 1, "e", False)], "id int, r int, generations string, exact boolean")
    assert {(r.id, r.generations, r.exact) for r in scoring.first_correct(rounds, "id", "r").collect()} == {(1, "b", True), (2, "d", False)}


def test_groups(spark):
    df = spark.createDataFrame([("a", 2, "y", [1]), ("a", 1, "x", [2, 3]), ("b", 3, "x", [])], "g string, o int, v string, l array<int>")
    assert {(r.g, r.v) for r in grouping.group_list(df, ["g"], "v", ["o"]).collect()} == {("a", "x"), ("a", "y"), ("b", "x")}
    assert {(r.g, tuple(r.v)) for r in grouping.group_small_list(df, ["g"], "v", "o", 2).collect()} == {("a", ("x", "y")), ("b", ("x",))}
    with pytest.raises(Exception, match="exceeds"):
        grouping.group_small_list(df, ["g"], "v", "o", 1).collect()
    assert sorted((r.g, r.l) for r in grouping.group_concat_lists(df, ["g"], "l").collect()) == [("a", 1), ("a", 2), ("a", 3)]
    assert grouping.group_set(df, ["v"], "g").count() == 3
    assert [r.v for r in grouping.sorted_list(df, ["g"], "v").collect()] == ["x", "y", "x"]


def test_eval_sets(spark):
    rows = [
        (f"{a}.{o}.{op}", a, o, op, kind, text, a.title(), o.title(), "Do it")
        for a, o in (("box", "file"), ("jira", "issue"), ("slack", "files"))
        for op, kind, text in (("CREATE", "actions", f"Creates in {a}."), ("UPDATED", "triggers", f"Triggers when {a} changes."))
    ]
    names = "command app object op kind description app_display_name object_display_name operation_display_name"
    commands = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    catalog = Catalog(None, None, None)
    object.__setattr__(catalog, "commands", commands)
    aliases = spark.createDataFrame([("Box", ["bx", "b2"]), ("Jira", [])], "app_display_name string, aliases array<string>")
    from corvane.plans.catalog import sample_corpus

    samples = sample_corpus(commands, "5", [3])
    censored = spark.createDataFrame([("box.file.CREATE", 2, "second"), ("box.file.CREATE", 1, "first")], "command string, source int, description_censored string")
    records = spark.createDataFrame([("Say", "a.b.C")], "utterances string, commands string")
    got = catalog.eval_sets(aliases, samples, censored, records).collect()
    by_type = {}
    for r in got:
        by_type.setdefault(r.type, []).append(r)
    assert {r.utterances.split()[2] for r in by_type[1]} <= {"bx", "b2", "when", "a"} and len(by_type[1]) == 2
    assert {r.commands.split(".")[1] for r in by_type[2]} == {"issue"}  # file and files fold together
    assert all("Jira" not in r.utterances for r in by_type[2])
    assert [(r.utterances, r.commands) for r in by_type[3]] == [("first", "box.file.CREATE")]
    assert len(by_type[4]) == 1000 and all(r.commands.count("\n") == 3 for r in by_type[4])
    assert [(r.utterances, r.commands) for r in by_type[6]] == [("Say", "a.b.C")]
    composed = evalsets.eval_trigger_composed(samples, commands, "1").collect()
    assert composed and all(r.commands.count("\n") == 3 for r in composed)
    assert verb_lemmatiser(spark) is not None


def test_only_commands_of_single_objects_are_stacked(spark, tmp_path, monkeypatch):
    lines = [(1, "A", 1), (1, "A", 2), (1, "A", 2), (2, "A", 1), (2, "N", 2), (3, "N", 1), (3, None, 2), (None, "R", 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_returnflag string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    stacked, plain = [], queries.generation.utterances
    monkeypatch.setattr(queries.generation, "utterances", lambda rows, seed: stacked.append(rows.count()) or plain(rows, seed))
    got = {r.commands for r in queries.single_object_eval(spark, str(tmp_path)).collect()}
    assert got == {"o1.A.CREATE", "o1.A.RETRIEVEALL", "o3.N.CREATE"} and stacked == [3]
